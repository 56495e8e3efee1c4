"""Sessions: workers that can't import the package, the shared folder, the batch bounds."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tokensieve.llm import scratch

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The driver finds the package by its own path, which workers don't inherit.
SCRIPT = """
import glob, os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + os.getcwd() + "/shared").getOrCreate()
def absent(batches):
    try:
        import tokensieve
        sys.exit("workers see the package")
    except ImportError:
        yield from batches
spark.range(4).mapInArrow(absent, "id long").count()
from tokensieve.llm import ann, quality, packing, queries, rules, substring, simhash, secrets, tokens, bpe, urls
import corpus_pipeline
sf = {sf!r}
some = os.getcwd() + "/some"
spark.read.parquet(sf + "/documents.parquet").where("doc_id % 4 = 0").write.parquet(some + "/documents.parquet")
for t in ("embeddings", "pages", "labels", "conversations"):
    spark.read.parquet(sf + "/" + t + ".parquet").limit(60).write.parquet(some + "/" + t + ".parquet")
for name, query in queries.QUERIES.items():
    query(spark, some).write.format("noop").mode("overwrite").save()
corpus_pipeline.run(spark, some).write.format("noop").mode("overwrite").save()
assert glob.glob("shared/*")
spark.stop()
print("LEFT", glob.glob("shared/tokensieve-*"))
"""


def test_workers_without_the_package(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, sf=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "LEFT []" in done.stdout


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)


def test_release(spark):
    mark = scratch.stored()
    one, two, three = (scratch.store(spark.range(n)) for n in (1, 2, 3))
    paths = [t._scratch for t in (one, two, three)]
    scratch.release(one, spark.range(3))
    scratch.release_since(mark, three)
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, False, True] and three.count() == 3
    scratch.release(three)
    assert scratch.stored() == mark


def test_batches_are_bounded(spark):
    scratch.small_batches(spark)
    sizes = lambda it: (type(b).from_arrays([__import__("pyarrow").array([b.num_rows])], ["n"]) for b in it)
    rows = spark.range(4000).coalesce(1).select(F.repeat(F.lit("x"), 10).alias("t")).mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in rows) <= scratch.BATCH_ROWS
    long = spark.range(64).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in long) == 64 and max(r.n for r in long) <= 8
