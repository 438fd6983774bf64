"""Field paths as typed questions, for struct columns and for VARIANT documents.

A ``Field`` answers what a predicate or a sort may ask of a value: is it there,
which JSON type has it, what is it as a string, number or boolean.  In a typed
collection the answers follow from the schema when the plan is built, so a
predicate is a plain expression that reaches the scan; in a schemaless one they
are guards on the variant's own type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError

SYSTEM = ("_v", "_seq", "_createdAt", "_modifiedAt")
DOC = "doc"
NO = F.lit


class Field:
    """A value at a path.  Subclasses set the columns; ``None`` says that a type can't occur."""

    present: Column
    string: Column | None = None
    number: Column | None = None
    boolean: Column | None = None
    whole_number: bool = False

    def element_like(self, needle: str) -> Column | None:
        """Some string element holds the needle, in any case."""
        return None

    def element_is(self, value) -> Column | None:
        """Some element equals the value."""
        return None

    def same_json(self, value) -> Column:
        return F.lit(False)

    def sort_keys(self) -> list[Column]:
        raise NotImplementedError


class Missing(Field):
    present = None

    def __init__(self):
        self.present = F.lit(False)

    def sort_keys(self):
        return []


class TypedField(Field):
    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind
        self.present = column.isNotNull()
        if isinstance(kind, T.StringType):
            self.string = column
        elif isinstance(kind, T.NumericType):
            self.number = column
            self.whole_number = isinstance(kind, T.IntegralType)
        elif isinstance(kind, T.BooleanType):
            self.boolean = column
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            self.string = column.cast("string")

    def element_like(self, needle):
        if isinstance(self.kind, T.ArrayType) and isinstance(self.kind.elementType, T.StringType):
            return F.exists(self.column, lambda x: F.contains(F.lower(x), F.lit(needle.lower())))
        return None

    def element_is(self, value):
        if not isinstance(self.kind, T.ArrayType):
            return None
        e = self.kind.elementType
        fits = isinstance(value, str) and isinstance(e, T.StringType) or isinstance(value, bool) and isinstance(e, T.BooleanType) or isinstance(value, (int, float)) and not isinstance(value, bool) and isinstance(e, T.NumericType)
        return F.exists(self.column, lambda x: x == F.lit(value)) if fits else F.lit(False)

    def same_json(self, value):
        if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(self.column) == F.to_json(F.parse_json(F.lit(_text(value))))
        return F.lit(False)

    def sort_keys(self):
        if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)):
            return [F.to_json(self.column)]
        return [self.column]


class VariantField(Field):
    """kind is schema_of_variant: null where the path is missing."""

    def __init__(self, value: Column):
        self.value = value
        kind = F.schema_of_variant(value)
        self.present = kind.isNotNull()
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
        self.string = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        self.number = F.when(number, F.try_variant_get(value, "$", "double"))
        self.boolean = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        self.array = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))
        self.null = kind == "VOID"
        self.kind = kind

    def element_like(self, needle):
        return F.exists(self.array, lambda x: (F.schema_of_variant(x) == "STRING") & F.contains(F.lower(F.try_variant_get(x, "$", "string")), F.lit(needle.lower())))

    def element_is(self, value):
        return F.exists(self.array, lambda x: same(VariantField(x), value))

    def same_json(self, value):
        return F.to_json(self.value) == F.to_json(F.parse_json(F.lit(_text(value))))

    def sort_keys(self):
        """String, number, array, false, null, true, object: the order of the JSON texts' first characters."""
        k = self.kind
        rank = F.when(k == "STRING", 0).when(self.number.isNotNull(), 1).when(F.startswith(k, F.lit("ARRAY")), 2).when(self.boolean == F.lit(False), 3).when(self.null, 4).when(self.boolean, 5).when(k.isNotNull(), 6)
        return [rank, self.number, self.string, F.when(rank.isin(2, 6), F.to_json(self.value))]


def _text(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def same(field: Field, value) -> Column:
    """Equality of JSON values, strings in any case, numbers as numbers."""
    if isinstance(value, bool):
        return field.boolean == F.lit(value) if field.boolean is not None else F.lit(False)
    if isinstance(value, (int, float)):
        if field.number is None:
            return F.lit(False)
        if field.whole_number or abs(value) > 1:
            return field.number == F.lit(value)
        return F.abs(field.number - F.lit(float(value))) < F.lit(2.0**-52)
    if isinstance(value, str):
        return F.lower(field.string) == F.lit(value.lower()) if field.string is not None else F.lit(False)
    return field.same_json(value)


class Resolver:
    """Finds fields by dotted path in a DataFrame of a collection."""

    def __init__(self, df: DataFrame):
        self.df, self.schema = df, df.schema
        self.variant = DOC in df.columns and isinstance(df.schema[DOC].dataType, T.VariantType)

    def field(self, path: str) -> Field:
        parts = path.split(".")
        top = {f.name: f.dataType for f in self.schema.fields}
        if parts[0] in ("_key", DOC) and not (parts[0] == DOC and not self.variant):
            return Missing()
        if parts[0] in top and not (self.variant and parts[0] == DOC):
            return self._walk(F.col(f"`{parts[0]}`"), top[parts[0]], parts[1:])
        return VariantField(F.try_variant_get(F.col(DOC), json_path(parts), "variant")) if self.variant else Missing()

    def _walk(self, column: Column, kind: T.DataType, rest: list[str]) -> Field:
        for k, name in enumerate(rest):
            if isinstance(kind, T.VariantType):
                return VariantField(F.try_variant_get(column, json_path(rest[k:]), "variant"))
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return Missing()
            column, kind = column.getField(name), kind[name].dataType
        return VariantField(column) if isinstance(kind, T.VariantType) else TypedField(column, kind)


def json_path(parts: list[str]) -> str:
    """The path of nested names, each in whichever quotes it doesn't hold."""
    if any("'" in p and '"' in p for p in parts):
        raise RequestError("A field name may not hold both kinds of quotes")
    return "$" + "".join(f"['{p}']" if "'" not in p else f'["{p}"]' for p in parts)
