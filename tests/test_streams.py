"""The living cache and the use log as streams."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from memloom.sources import use_log
from memloom.streaming import semantic_cache as sc

SCHEMA = "key string, id long, at timestamp, context array<double>, query array<double>, answer string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def plain(batches, context, query, ttl, most):
    """All caches in one loop over the batches."""
    caches, seen, out, mark, coming = {}, {}, [], datetime(1, 1, 1), datetime(1, 1, 1)

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    for batch in batches:
        for key, id_, at, c, q, answer in sorted(batch, key=lambda r: (r[2], r[1])):
            if at <= mark:
                continue  # behind the watermark
            key = key or ""
            now = seen[key] = max(seen.get(key, datetime(1, 1, 1)), at)
            live = caches[key] = [e for e in caches.get(key, []) if (now - e["last"]).total_seconds() < ttl]
            if q is None or not any(q):
                out.append((key, id_, False, None, None, answer))
                continue
            hit = next((e for e in live if (c is None) == (e["c"] is None) and (c is None or round(cosine(c, e["c"]), 9) >= context) and round(cosine(q, e["q"]), 9) >= query), None)
            if hit:
                hit["hits"] += 1
                hit["last"] = now
                out.append((key, id_, True, hit["id"], hit["hits"], hit["answer"]))
                continue
            live.append({"id": id_, "c": c, "q": q, "answer": answer, "hits": 1, "last": now})
            if len(live) > most:
                live.remove(min(live, key=lambda e: (e["hits"], e["last"])))
            out.append((key, id_, False, None, None, answer))
        mark, coming = coming, max(coming, max(r[2] for r in batch) - timedelta(hours=9))
    return sorted(out, key=str)


def replay(spark, tmp_path, batches, **settings):
    folder, rows = tmp_path / "in", []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{n:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = sc.answers(stream, delay="9 hours", **settings).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(b.collect())).start()
    query.awaitTermination()
    return sorted(((r.key, r.id, r.hit, r.entry, r.hits, r.answer) for r in rows), key=str)


def test_replay_equals_a_plain_loop(rocks, tmp_path):
    rng = random.Random(10)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(8)]
    start, batches, n = datetime(2024, 1, 1), [], 0
    for b in range(6):
        batch = []
        for _ in range(25):
            q = [x + rng.gauss(0, 0.1) for x in rng.choice(base)]
            c = rng.choice([None, base[0], base[1]])
            late = rng.choice([0, 0, 0, 3, 20])  # hours, behind the watermark too
            batch.append((rng.choice(["a", "b", None]), n, start + timedelta(hours=7 * b - late, minutes=rng.randrange(300)), c, q, f"r{n}"))
            n += 1
        batches.append(batch)
    batches[1] += [("a", 900, batches[1][0][2], None, None, "none"), ("a", 901, batches[1][0][2], None, [0.0] * 5, "zero")]
    settings = {"context": 0.9, "query": 0.9, "ttl": 8 * 3600, "most": 4}
    got, want = replay(rocks, tmp_path, batches, **settings), plain(batches, **settings)
    assert got == want and sum(r[2] for r in got) > 20


def test_log_takes_each_batch_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "id long, query string"
    batch = spark.createDataFrame([(i, f"q{i}") for i in range(30)], schema)
    use_log.record(batch, 0, path, "recall")
    use_log.record(batch.where("id < 10"), 1, path, "recall")
    use_log.record(batch, 0, path, "recall")  # a replay
    use_log.record(batch, 0, path, "skill")
    assert use_log.read(spark, path, schema).groupBy("source").count().collect().__len__() == 2
    assert use_log.read(spark, path, schema).where("source = 'recall'").count() == 40
    (tmp_path / "log" / "source=skill" / "batch=0" / "_SUCCESS").unlink()  # a write cut short
    assert use_log.read(spark, path, schema).count() == 40
    assert use_log.read(spark, f"{path}-none", schema).count() == 0
    with pytest.raises(ValueError):
        use_log.record(batch, 0, path, "a/b")


def test_log_of_a_stream_that_is_run_again(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "id long, query string"
    for n in range(3):
        spark.createDataFrame([(n, "x")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        use_log.log_recall(stream, path, "recall", f"{tmp_path}/checkpoint", None).awaitTermination()
    # the last commit is lost: its batch runs again and adds nothing
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    use_log.log_recall(stream, path, "recall", f"{tmp_path}/checkpoint", None).awaitTermination()
    assert use_log.read(spark, path, schema).count() == 3
