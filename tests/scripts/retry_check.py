"""Run sliced scans and a decode twice — once with the first attempt of half the upstream tasks
failing — and print whether the results are identical. Needs a master that retries tasks."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from strata.operators import decode as dec  # noqa: E402
from strata.operators.evaluate import evaluate  # noqa: E402
from strata.plans.fixtures import ARMS, BATCH_SIZE, K, eval_completions, eval_prompts  # noqa: E402
from strata.operators.scan import inverse_cdf, prefix_sum  # noqa: E402
from strata.session import DEFAULT_CONF, ensure_checkpoint_dir  # noqa: E402


SMALL = "/root/testdata/sf0.001"
MARKS = tempfile.mkdtemp(prefix="strata-retry-")  # test-local folder for failure markers


def flaky(batches):
    from pyspark import TaskContext

    tc = TaskContext.get()
    if tc.attemptNumber() == 0 and tc.partitionId() % 2 == 0:
        open(os.path.join(MARKS, f"{tc.stageId()}-{tc.partitionId()}"), "w").close()
        raise RuntimeError("injected task failure")
    yield from batches


def main():
    b = SparkSession.builder.master("local[4,4]").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(spark)
    rows = [("hot", i, (i * 7) % 5 + 1) for i in range(4000)] + [(f"k{i % 300}", i, 1) for i in range(3000)]
    base = spark.createDataFrame(rows, "g string, o long, v long").repartition(6)
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 12))) for i in range(60)], "doc_id long, text string"
    ).repartition(6)

    def run(make_flaky):
        src = base.mapInPandas(flaky, base.schema) if make_flaky else base
        ps = sorted(tuple(r) for r in prefix_sum(src, ["g"], [F.col("o")], F.col("v"), slices=5).collect())
        cdf = prefix_sum(src, ["g"], [F.col("o")], F.col("v"), slices=5).select(
            "g", F.col("o").alias("token"), (F.col("cum_excl") / F.col("cum_total")).alias("lo"),
            (F.col("cum_incl") / F.col("cum_total")).alias("hi"),
        )
        pts = spark.range(200).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("k1").alias("g"),
                                      F.col("id").alias("pid"), ((F.col("id") * 37 % 200) / 200.0).alias("c"))
        look = sorted(tuple(r) for r in inverse_cdf(pts, cdf, ["g"], take=("token",), slices=5).collect())
        d = docs.mapInPandas(flaky, docs.schema) if make_flaky else docs
        out = dec.decode(dec.document_prompts(d), dec.bigram_table(d), num_samples=3, max_steps=5)
        dd = sorted((r.group_id, r.g, tuple(r.out)) for r in out.collect())
        li = eval_completions(spark, SMALL)
        li = li.mapInPandas(flaky, li.schema) if make_flaky else li
        ev = sorted(tuple(r) for r in evaluate(eval_prompts(spark, SMALL), li, K, ARMS, batch_size=BATCH_SIZE).collect())
        return ps, look, dd, ev

    clean, retried = run(False), run(True)
    failures = len(os.listdir(MARKS))
    ok = clean == retried and failures > 0
    print("IDENTICAL" if ok else "DIFFERENT", "injected_failures=%d" % failures, [len(x) for x in clean])


if __name__ == "__main__":
    main()
