"""Texts packed for an exchange come back whole, and op7's report sends them packed without a change of its rows."""

import collections
import hashlib
import random

from factspark.llm import fingerprint, packing


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))


def shuffled(spark):
    """Bytes that all tasks so far have written for exchanges."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_texts_come_back_whole(spark, monkeypatch):
    rng = random.Random(3)
    noise = "".join(map(chr, rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 3000)))
    texts = [None, "", "a", "\0", "ab" * 40_000, noise, words(rng, 500), "é 🙂" * 9, "x" * 300_000] * 3
    rows = [(k, t, None if k % 4 else "z") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, other string").repartition(2)
    sent = packing.packed(df)
    assert sent.columns == ["id", "other", "packed", "size"]
    for r in sent.collect():
        t = texts[r["id"]]
        assert (r["packed"] is None and r["size"] is None) if t is None else len(r["packed"]) <= r["size"] == len(t.encode())
    monkeypatch.setattr(packing, "CHUNK_BYTES", 1000)
    back = packing.unpacked(sent)
    assert sorted(map(tuple, back.select("id", "text", "other").collect())) == rows
    assert packing.unpacked(packing.packed(df.limit(0))).count() == 0


def test_report_sends_texts_packed(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, 1000)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    before = shuffled(spark)
    assert len(fingerprint.edit_report(df).collect()) == len(rows)
    assert shuffled(spark) - before < 0.9 * sum(len(t) for _, t in rows)


def test_report_orders_repeated_ids_by_text(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 7]), rng.choice([None, "", "b", words(rng, 60), "same text of five words"])) for _ in range(60)]
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.edit_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    order = sorted((-(1 << 63) if i is None else i, t or "") for i, t in rows)
    want = collections.Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        new = fingerprint.edited(t, following)
        want[(None if i == -(1 << 63) else i, len(t), hashlib.sha256(new.encode()).hexdigest())] += 1
    assert got == want
