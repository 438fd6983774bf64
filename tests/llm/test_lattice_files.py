import random
import time

import corpus_pipeline
from quern.llm import sentencepiece


def test_the_lattice_leaves_no_shuffle_files(spark, docs):
    """What counting and folding shuffled is gone once the lattice is written; a count of rows may leave some bytes."""
    r = random.Random(8)
    df = docs([(i, " ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(200)), "en") for i in range(60)])

    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {(f.getName(), f.length()) for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}

    before = left()
    assert sentencepiece.lattice(df, sentencepiece.Vocabulary(corpus_pipeline.VOCABULARY)).count() > 1000
    size = lambda: sum(n for _, n in left() - before)
    for _ in range(50):  # files go in the background
        if size() < 30_000:
            break
        time.sleep(0.2)
    assert size() < 30_000
