"""Each stage of the pipeline and the whole of it against plain Python, on a table with copies, junk, benchmark passages and odd rows."""

import base64
import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from factspark.llm import icws, quality, text

SF = "/root/testdata/sf0.001"
ASCII_WORD = r"[0-9a-zA-Z\x80-\U0010ffff]+"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.orderBy("doc_id").where("n_chars > 500").first()
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (None, "A row that has no id at all. It stays as it is.", "en", "x", 9), tuple(long), (900_003, long["text"], "en", "x", 5), (900_004, long["text"].replace("the", "THE"), None, "x", 7), (900_005, "# $ % ^ " * 300, "en", "x", 1)]
    flat = re.sub(r"\s+", " ", long["text"])  # near copies of one line each, which line dedup leaves
    odd += [(900_010 + k, f"{flat} {end}", "en", "x", 5) for k, end in enumerate(("once", "twice over", "three times in all"))]
    docs.unionByName(docs.sparkSession.createDataFrame(odd, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(800, None), (801, "")], "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    return path


def quality_of(spark, rows, path):
    """The scorer's sum for each text, byte by byte."""
    model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"))

    def keep(t):
        b = (t or "").encode()
        words = re.split(rb"[\t\n\x0b\x0c\r ]+", b.strip(b"\t\n\x0b\x0c\r "))
        words = [(w[:6], min(len(w), 63)) for w in words if w]
        echo = sum(w in words[max(0, k - 2) : k] for k, w in enumerate(words)) / max(len(words), 1)
        z = model.bias + float(model.weights[quality.DIMENSIONS]) * echo
        at = [(((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for k in range(len(b) - 2)]
        return z + (sum(float(model.weights[a]) for a in at) + quality.PRIOR_TRIGRAMS * model.odds) / (max(len(b) - 2, 0) + quality.PRIOR_TRIGRAMS) >= 0

    return [r for r in rows if keep(r[1])]


def lines_of(spark, rows, path):
    """Line by line in order of (id, text): lines of five words and pairs of lines that stood before go."""
    seen, verdict = set(), {}
    for i, t in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows}):
        parts = t.split("\n")
        solid = [k for k, x in enumerate(parts) if x.strip("\t\x0b\x0c\r ")]
        said = [parts[k].strip("\t\x0b\x0c\r ") for k in solid]
        drop = set()
        for n in (1, 2):
            for x in range(len(said) - n + 1):
                w = tuple(said[x : x + n])
                if n == 2 or len(re.findall(ASCII_WORD, w[0])) >= 5:
                    if w in seen:
                        drop |= set(range(x, x + n))
                    seen.add(w)
        begin = [0] + solid[1:]
        chunks = ["\n".join(parts[a:b]) + ("\n" if b < len(parts) else "") for a, b in zip(begin, [*begin[1:], len(parts)], strict=True)]
        verdict[i, t] = "".join(c for x, c in enumerate(chunks) if x not in drop) if solid else t
    out = []
    for r in rows:
        t = verdict[-1 if r[0] is None else r[0], r[1] or ""]
        out.append((r[0], t, r[2], r[3], len(t)))
    return out


def near_of(spark, rows, path):
    """Every pair's weighted Jaccard similarity; the least id of each component stays."""
    known = sorted({(r[0], r[1]) for r in rows if r[0] is not None})
    n = sum(r[0] is not None for r in rows)
    words = {d: re.findall(r"[0-9a-z\x80-\U0010ffff]+", d[1].lower()) for d in known}
    shingles = {d: [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))] for d, w in words.items()}
    feature = {}
    for d in known:
        feature |= dict(zip(shingles[d], (text.shingle_hashes(pa.array([d[1]]))[0] >> np.uint64(44)).tolist(), strict=True))
    count = collections.Counter(f for r in rows if r[0] is not None for f in {feature[s] for s in shingles[r[0], r[1]]})

    def weight(s):
        idf = 1 + math.log((1 + n) / (1 + min(count[feature[s]], n)))
        return math.exp(min(max(round(0.5 * math.log(idf) * 12), 0), 15) / 12)

    bags = {d: collections.Counter(s) for d, s in shingles.items()}
    total = {d: sum(weight(s) * c for s, c in b.items()) for d, b in bags.items()}
    parent = {d: d for d in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in known:
        for b in known:
            if b < a and a[1] == b[1]:
                parent[max(find(a), find(b))] = min(find(a), find(b))
            elif b < a and bags[a] and bags[b]:
                both = sum(weight(s) * min(c, bags[b][s]) for s, c in bags[a].items() if s in bags[b])
                if both >= 0.8 * (total[a] + total[b] - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return [r for r in rows if r[0] is None or find((r[0], r[1])) == (r[0], r[1])]


def clean_of(spark, rows, path):
    def words(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    items = [words(r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    needs = [{tuple(q[k : k + min(5, len(q))]) for k in range(len(q) - min(5, len(q)) + 1)} for q in items if q]

    def leaked(t):
        w = words(t)
        have = {tuple(w[k : k + n]) for n in {len(next(iter(x))) for x in needs} for k in range(len(w) - n + 1)}
        return any(len(x & have) >= 0.8 * len(x) for x in needs)

    bad = {r[0] for r in rows if leaked(r[1])}
    return [r for r in rows if r[0] not in bad]


def encoded_of(spark, rows, path):
    import public_tokenizers
    import tiktoken

    with open(corpus_pipeline.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = known.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], [quality_of, lines_of, near_of, clean_of], strict=True):
        docs = stage(spark, docs, folder).checkpoint()
        assert docs.columns == columns, name
        before, rows = rows, brute(spark, rows, folder)
        got = [tuple(r) for r in docs.collect()]
        if name == "quality":  # an empty text may be null or empty until lines are cut
            assert in_order((r[0], r[1] or "", *r[2:]) for r in got) == in_order((r[0], r[1] or "", *r[2:]) for r in rows), name
        else:
            assert in_order(got) == in_order(rows), name
        assert rows != before, name  # the stage's decisions take effect
    rows = encoded_of(spark, rows, folder)
    last = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert in_order(last.collect()) == in_order(rows) and rows


def test_empty_tables(spark, tmp_path):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
