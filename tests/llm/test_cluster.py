"""Results on several executors, where rows of a bucket come in another order whenever they are read."""

import os
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path[:0] = [{here!r}, {home!r}]
import brute
from conftest import hard_rows
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from sentloom.llm import exchange, language_model, near_dedup, substring_dedup, suffix_dedup

spark = SparkSession.builder.master("local-cluster[2,1,900]").config("spark.executor.memory", "600m").config("spark.sql.shuffle.partitions", "5").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
rows = hard_rows()
spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet({shared!r} + "/docs")
docs = spark.read.parquet({shared!r} + "/docs")
values = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
suffix_dedup.BUCKET_BYTES = substring_dedup.BUCKET_BYTES = language_model.BLOCK_BYTES = 1 << 13
plain = lambda x: sorted(x, key=repr)
for width in (400, 60):
    out = suffix_dedup.suffix_dedup(docs, width)
    assert values(out, "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), (F.size("spans") / 2).cast("int"), F.sha2("kept", 256)) == plain(brute.suffix(rows, width)), width
out = substring_dedup.substring_dedup(docs, 13)
assert values(out, "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)) == plain(brute.substring(rows))
since = exchange.mark()
out = near_dedup.near_groups(docs)
assert values(out, "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id"))) == plain(brute.near(rows))
exchange.forget(spark, since)
got = sorted(language_model.language_scores(docs, states=2, least=2, most=2).collect(), key=repr)
assert [tuple(r)[:5] for r in got] == [x[:5] for x in plain(brute.unigram(rows))]
print("ALL RIGHT")
"""


def test_on_executors(tmp_path):
    script = SCRIPT.format(here=str(Path(__file__).resolve().parent), home=str(HOME), shared=str(tmp_path / "shared"))
    env = os.environ | {"PYTHONPATH": f"{HOME}:{os.environ.get('PYTHONPATH', '')}", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_WORKER_DIR": str(tmp_path / "work")}
    run = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=600)
    assert "ALL RIGHT" in run.stdout, run.stderr[-3000:]
