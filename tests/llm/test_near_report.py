"""op7's query names the class of near texts of each document, by joined bands and verified pairs."""

import collections

import pyarrow as pa

from factspark.llm import queries, text

SF = "/root/testdata/sf0.001"


def test_report_has_classes_of_near_texts(spark, tmp_path):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{k}" for k in range(200)]
    odd = [(9000, " ".join(base)), (9001, " ".join([*base[:100], "other", *base[101:]])), (9002, " ".join(base)), (9003, None), (9004, ""), (9005, "!"), (9006, " ".join(base[100:])), (None, " ".join(base))]
    rows = given + odd + given[:3]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_fingerprints"](spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    known = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [set(text.shingle_hashes(pa.array([t]))[0].tolist()) for _, t in known]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(known):
        for y in range(x):
            if known[y][1] == a or sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    want = collections.defaultdict(set)
    for x, (i, _) in enumerate(known):
        want[i].add(known[find(x)][0])
    for r in got:
        assert (r["class_id"] is None) if r["doc_id"] is None else r["class_id"] in want[r["doc_id"]], r["doc_id"]
    assert {r["doc_id"]: r["class_id"] for r in got}[9001] == 9000
