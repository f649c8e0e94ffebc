"""What Python workers hold at once, and over how many tasks costly rows are dealt."""

import html
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.plans import chains
from tidewell.sources import envelopes

PYTHON_LD = re.compile(r"<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>", re.I | re.S)


def test_a_batch_is_decoded_a_few_texts_at_once():
    seen = []
    texts = [None if i % 7 == 0 else f"a &amp{';' * (i % 2)} {i} &notit; &#x41;" for i in range(2000)]
    got = text.by_slices(pa.array(texts), lambda items: seen.append(len(items)) or [x and html.unescape(x) for x in items], pa.string())
    assert max(seen) <= text.ITEMS_AT_ONCE and got.to_pylist() == [x and html.unescape(x) for x in texts]


def test_entities_and_lists_decode_like_python(spark):
    texts = [None, "", "plain", "&", "&amp;lt;", "&ampx &lt &#39; &#x27; &nbsp;", "&bogus; &#0;"]
    rows = spark.createDataFrame([(i, t, [t, "&gt;", None] if i % 2 else None) for i, t in enumerate(texts)], "i int, t string, l array<string>").coalesce(1)
    got = rows.select("i", text.unescape("t").alias("t"), text.unescape_all("l").alias("l")).orderBy("i").collect()
    assert [r.t for r in got] == [t and html.unescape(t) for t in texts]
    assert [r.l for r in got] == [[html.unescape(x) for x in (t, "&gt;") if x is not None] if i % 2 else None for i, t in enumerate(texts)]


def test_only_blocks_leave_the_jvm_and_they_are_those_of_python(spark):
    open_ = ['<script type="application/ld+json">', "<SCRIPT a=1 Type =\x1c'application/LD+json' b>", "<scripts type=application/ld+json>", "<scripté type=application/ld+json>", "<script_ type=application/ld+json>", "<script-x type=application/ld+json>", "<script type=text/x>", "<ſcript type=application/ld+json>"]
    pages = [f"x{o}{{\n1}}</script >y{p}2</SCRIPT>" for o in open_ for p in open_] + ["", "no", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = rows.select(F.regexp_extract_all("html", F.lit(envelopes.LD_JSON), F.lit(1)).alias("b"), envelopes.ld_postings("html").alias("p"))
    blocks = [r[0] for r in got.select("b").collect()]
    assert blocks == [None if p is None else PYTHON_LD.findall(p) for p in pages]
    assert got.where("size(p) > 0 or p is null").count() == 0
    plan = rows.select(envelopes.ld_postings("html"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(html" in plan.split("ArrowEvalPython")[1].split("[pythonUDF")[0]


def test_postings_of_one_file_are_structured_by_many_tasks(spark, tmp_path):
    part = spark.range(400).selectExpr("id AS p_partkey", "'large ring' AS p_name", "'Brand#1' AS p_brand", "CAST(1 AS INT) AS p_size")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, out = chains._structured(spark, str(tmp_path))
        rows = out.select("job_id", "payload", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) == 400 and len({r.task for r in rows}) == 4
