from tidemark.operators import verdict
from tidemark.streaming import audit


def frames(spark, episodes):
    rows = [(ep, fi, fi * 0.1, [float((fi * fi * (ep + 3)) % 7)], [float(fi), float(ep)]) for ep in episodes for fi in range(20 + ep)]
    return spark.createDataFrame(rows, audit.FRAMES)


def test_stream_gives_the_verdicts_of_one_batch(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{k}" for k in ("in", "out", "mark"))
    for part in ([0, 1], [2], [3, 4]):
        frames(spark, part).coalesce(1).write.mode("append").parquet(source)
    audit.audit_stream(audit.read_frames(spark, source, files=1), out, mark).awaitTermination(120)
    got = spark.read.parquet(out)
    want = verdict.judged(verdict.scalars(frames(spark, range(5))))
    assert got.select("batch").distinct().count() == 3
    assert sorted(got.drop("batch").select(want.columns).collect()) == sorted(want.collect())
    audit.audit_stream(audit.read_frames(spark, source, files=1), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5


def test_frame_rates_by_window(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    frames(spark, [0, 90]).coalesce(1).write.parquet(source)
    query = audit.frame_rates(audit.read_frames(spark, source)).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.ep, r.start.second): r.frames for r in spark.table("rates").collect()}
    assert got == {(0, 0): 20, (90, 0): 100, (90, 10): 10}
