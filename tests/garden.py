"""A garden for the tests of a database: soils and beds by rule, plants that refer to both."""

SOILS = {f"soil-{n}": {"ph": 4.5 + n / 2, "drains": n % 2 == 0, "texture": ("clay", "loam", "sand")[n % 3], "depth": 20 + 15 * n} for n in range(4)}
BEDS = {f"bed-{c}": {"sun": 2 * k + 1, "length": 1.5 * (k + 1), "edge": None if c == "C" else ("Brick", "timber")[k % 2]} for k, c in enumerate("ABC")}
NAMES = ["Borage", "chervil", "Dill", "fennel", "Lovage", "mint", "Sorrel", "tansy"]
PLANTS = {
    f"plant_{n}": {
        "name": name,
        "height": 30 + 37 * n % 101,
        "hardy": n % 3 != 1,
        "soil": f"soil-{n % 5}",
        "bed": f"bed-{'ABC'[n % 3]}",
        "uses": [u for k, u in enumerate(("tea", "salad", "dye", "bees")) if (n + k) % 3 == 0],
        "seed": {"origin": {"region": ("North", "South", "north")[n % 3], "year": 2000 + n}, "grams": 0.25 * n},
    }
    for n, name in enumerate(NAMES)
}
