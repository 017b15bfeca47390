"""Each operator against a brute-force version, with null, empty, repeated and tied rows and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factspark.llm import bpe, chat, containment, fingerprint, graph, html, icws, lines, quality, sentences, suffix, text

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, tag string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    """Random texts with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]

    def sentence():
        return " ".join(rng.choices(words, k=rng.randint(3, 12))).capitalize() + rng.choice([".", "!", "?"])

    passage = [sentence() for _ in range(6)]
    rows = []
    for k in range(60):
        lines_ = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]
        if k % 3 == 0:
            lines_.insert(rng.randrange(len(lines_) + 1), " ".join(passage))
        if k % 4 == 0 and rows:
            lines_ = rng.choice(rows)[1].split("\n")
            if k % 8 == 0 and lines_[0]:
                lines_[0] = lines_[0] + " changed"
        rows.append((k * 3, "\n".join(lines_)))
    rows += [(500, None), (501, ""), (502, "   \n\n "), (503, "one"), (504, "ab " * 3000), (505, "ab " * 3000), rows[5], rows[5], (9, "another text of one id. It is short."), (None, "no id here at all"), (600, "x" * 49), (601, "x" * 50), (602, "x" * 51), (603, "y" * 70000), (604, "z" + "y" * 200)]
    return rows, spark.createDataFrame([(i, t, "i", "t", 1) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    """Rows in order, null texts empty, null ids least, equal rows once."""
    return sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows})


def test_hashes_do_not_depend_on_the_batch(docs):
    texts = pa.array([t for _, t in docs[0]])
    whole, offs = text.shingle_hashes(texts)
    alone = [text.shingle_hashes(texts[k : k + 1])[0] for k in range(len(texts))]
    assert all((whole[offs[k] : offs[k + 1]] == alone[k]).all() for k in range(len(texts)))
    for k, t in enumerate(texts.to_pylist()):
        n = len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))
        assert len(alone[k]) == (max(n - 4, 1) if n else 0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_near_duplicates(spark, docs):
    rows, df = docs
    got = icws.near_duplicate_classes(df).collect()
    assert len(got) == len(rows)
    want = near_groups(rows)
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == collections.Counter((i, want[i, t or ""]) for i, t in rows if i is not None)
    assert {r["kept"] for r in got if r["doc_id"] is None} == {True}
    assert {r["class_id"] for r in got if r["kept"] and r["doc_id"] is not None} == set(want.values())
    assert icws.near_duplicate_classes(empty(spark)).count() == 0


def near_groups(rows):
    """The least id of each document's class, by shingles, counts and weights of its own and all pairs."""
    known = sorted({(i, t or "") for i, t in rows if i is not None})
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) for _, t in known]
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))) for w in words]
    slot = {s: int(text.shingle_hashes(pa.array([" ".join(s)]))[0][0] >> np.uint64(44)) for b in bags for s in b}
    n, at = sum(i is not None for i, _ in rows), {d: k for k, d in enumerate(known)}
    df = collections.Counter(x for i, t in rows if i is not None for x in {slot[s] for s in bags[at[i, t or ""]]})
    weight = {s: math.exp(round(0.5 * math.log(1 + math.log((1 + n) / (1 + df[x]))) * 12) / 12) for s, x in slot.items()}
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(bags):
        for y in range(x):
            b = bags[y]
            both = sum(weight[s] * min(c, b[s]) for s, c in a.items() if s in b)
            whole = sum(weight[s] * c for s, c in a.items()) + sum(weight[s] * c for s, c in b.items()) - both
            if known[x][1] == known[y][1] or words[x] == words[y] != [] or both >= 0.8 * whole > 0:
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {d: known[find(x)][0] for x, d in enumerate(known)}


def test_one_id_with_several_texts(spark):
    """A text that only shares its id with a copy is kept."""
    a, q, z = ("alpha beta gamma delta epsilon", "one two three four five six", "an other text altogether here")
    rows = [(3, a), (9, a), (9, q), (12, z), (13, None), (14, ""), (15, "!"), (16, "!")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, key int")
    assert sorted(tuple(r)[:2] for r in icws.keep_one(df).fillna("").collect()) == [(3, a), (9, q), (12, z), (13, ""), (15, "!")]


def test_weighted_sampling_is_unbiased():
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = base[:300] + [f"v{k}" for k in range(100)]
    levels = np.random.default_rng(0).integers(6, 13, 1 << icws.FEATURE_BITS).astype(np.uint8)
    mine, theirs = ({" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, other))

    def mass(shingles):
        return sum(math.exp(levels[int(text.shingle_hashes(pa.array([x]))[0][0] >> np.uint64(44))] / 12) for x in shingles)

    true = mass(mine & theirs) / mass(mine | theirs)
    words, offs = text.word_hashes(pa.array([" ".join(base), " ".join(other)]))
    drawn = np.array(list(icws.samples(words, offs, levels, 0, 4000)))
    assert abs((drawn[:, 0] == drawn[:, 1]).mean() - true) < 0.03


def test_containment(spark, docs):
    rows, df = docs
    rng = random.Random(5)
    items = []
    for k in range(30):
        words = re.findall(r"\w+", rng.choice(rows)[1] or "a b c")
        at = rng.randrange(max(1, len(words) - 30))
        part = words[at : at + rng.choice([1, 3, 5, 8, 20, 30])]
        if k % 3 == 0 and part:
            part[rng.randrange(len(part))] = "zzz"
        items.append((k, " ".join(part)))
    items += [(100, None), (101, "  "), (3, items[3][1])]

    def words(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    want = set()
    for i, t in {r for r in rows}:
        w = words(t)
        for n, s in items:
            q = words(s)
            width = min(5, len(q))
            if not q:
                continue
            need = {tuple(q[x : x + width]) for x in range(len(q) - width + 1)}
            have = {tuple(w[x : x + width]) for x in range(len(w) - width + 1)} & need
            if len(have) >= 0.8 * len(need):
                want.add((i, n, len(have), len(need)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = containment.contained_items(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got} == want and want
    left = containment.clean_documents(df, bench)
    assert left.columns == df.columns and left.count() == sum(i not in {w[0] for w in want} for i, _ in rows)
    assert containment.contained_items(empty(spark), bench).count() == 0 == containment.contained_items(df, bench.limit(0)).count()


def test_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(700, "a  \n\n  b 'S don't 12345 ١٢٣ 你好 🙂🙂 <|endoftext|> " + "q" * 5000), (701, "\x00\x01")]
    rows = docs[0] + extra
    df = spark.createDataFrame([(i, t, "i", "t", 1) for i, t in rows], SCHEMA)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, path).collect())
    want = collections.Counter()
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(empty(spark), path).count() == 0
    one = bpe.encode(df.where("doc_id = 700"), path)
    assert bytes(bpe.decode(one, path).first()["data"]).decode() == extra[0][1]
    h = bpe.codec(path).hash
    assert sorted(h.key_at.tolist()) == list(range(len(ranks)))


def _removed(rows, cut, windows):
    """Brute force of pieces: which pieces are covered by a window that an earlier place has."""
    seen, out = set(), {}
    for i, t in plain(rows):
        pieces = cut(t)
        drop = [False] * len(pieces)
        for n, good in windows:
            for x in range(len(pieces) - n + 1):
                w = pieces[x : x + n]
                if good(w):
                    if (n, tuple(w)) in seen:
                        drop[x : x + n] = [True] * n
                    seen.add((n, tuple(w)))
        out[i, t] = sum(drop)
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_line_dedup(spark, docs, least):
    rows = [r for r in docs[0] if r[0] != 9]
    df = spark.createDataFrame([(i, t, "i", "t", 1) for i, t in rows], SCHEMA)
    count = lambda s: len(re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", s))
    want = _removed(rows, lambda t: [x.strip() for x in t.split("\n") if x.strip()], [(1, lambda w: count(w[0]) >= least), (2, lambda w: True)])
    for r in lines.dedup_lines(df, least_words=least).collect():
        i = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        assert r["n_removed"] in {n for (k, _), n in want.items() if k == i}
        if r["n_removed"] == 0:
            assert r["text"] in {t for k, t in want if k == i}
    kept = lines.dedup_lines(df, carry=True)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_suffixes(spark):
    """Ranks are an order of suffixes, and covers the longest power of two (or rest) that an earlier place has."""
    rng = random.Random(3)
    texts = ["\n".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(25)] + ["\n".join("xy" * 20), "\n".join("xy" * 20 + "z"), "\n".join("x" * 33), "q\nr", "q"]
    texts += [texts[3], texts[25]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    own = lines._lines(lines.documents(df).withColumn("tag", lines.F.hash("text")).withColumn("doc", lines.F.xxhash64("id", "text")))
    got = {(r["id"], r["place"]): r for r in lines.suffix_ranks(own).collect()}
    said = [t.split("\n") for t in texts]
    every = [(i, k) for i, t in enumerate(said) for k in range(len(t))]
    times = collections.Counter(x for t in said for x in t)
    assert set(got) == {(i, k) for i, k in every if times[said[i][k]] > 1}

    def common(a, b):
        n = 0
        for x, y in zip(said[a[0]][a[1] :], said[b[0]][b[1] :], strict=False):
            if x != y:
                break
            n += 1
        return n

    order = sorted(got, key=lambda p: (got[p]["rank"], got[p]["sub"], p))
    near = [common(x, y) for x, y in zip(order, order[1:], strict=False)]
    for x in range(0, len(order), 7):  # the common prefix of any two is the least of those between them
        for y in range(x + 1, min(len(order), x + 40)):
            assert common(order[x], order[y]) == min(near[x:y])
    for p, r in got.items():
        rest = len(said[p[0]]) - p[1]
        shared = {q: common(p, q) for q in every if q < p}
        n = max(shared.values(), default=0)
        best = 1 << (n.bit_length() - 1) if n else 0
        if any(c == rest == len(said[q[0]]) - q[1] for q, c in shared.items()):
            best = rest
        assert (r["left"], r["cover"]) == (rest, best), (p, r, n)


def test_span_dedup(spark, docs):
    rows = [r for r in docs[0] if r[0] != 9]
    df = spark.createDataFrame([(i, t, "i", "t", 1) for i, t in rows], SCHEMA)

    def cut(t):
        found = [tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in s))) for s in re.split(r"(?<=[.!?])(?=\s)|\n", t)]
        return [s for s in found if s]

    total = lambda w: sum(map(len, w))
    want = _removed(rows, cut, [(3, lambda w: True), (2, lambda w: total(w) >= sentences.PAIR_WORDS)])
    for r in sentences.remove_repeated_spans(df).collect():
        i = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        assert r["n_removed"] in {n for (k, _), n in want.items() if k == i}, (r, want)
    assert sum(want.values()) > 20 and sentences.remove_repeated_spans(empty(spark)).count() == 0


def test_suffix_dedup(spark, docs):
    rows, df = docs
    first, want = {}, {}
    texts = plain(rows)
    for i, t in texts:
        b = t.encode()
        for x in range(len(b) - 49):
            first.setdefault(b[x : x + 50], i)
    for i, t in texts:
        b = t.encode()
        cover = np.zeros(len(b) + 1, int)
        for x in range(len(b) - 49):
            if first[b[x : x + 50]] < i:
                cover[x] += 1
                cover[x + 50] -= 1
        drop = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~drop].tobytes()
        spans = int(np.diff(np.concatenate(([0], drop.astype(int)))).clip(0).sum())
        want.setdefault(i, set()).add((len(b), int(drop.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix.remove_substrings(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in want[-(1 << 63) if r["doc_id"] is None else r["doc_id"]], r["doc_id"]
    assert suffix.remove_substrings(empty(spark)).count() == 0


def test_fingerprints(spark, docs):
    rows = [r for r in docs[0] if r[0] not in (9, docs[0][5][0])]
    df = spark.createDataFrame([(i, t, "i", "t", 1) for i, t in rows], SCHEMA)
    order = sorted((-(1 << 63) if i is None else i, t or "") for i, t in rows)
    got = {-(1 << 63) if r["doc_id"] is None else r["doc_id"]: r for r in fingerprint.edit_report(df).collect()}
    assert len(got) == len(order)
    by_text = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        sets = [set(text.shingle_hashes(pa.array([x]))[0].tolist()) for x in (t, new, following)]
        for column, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            true = len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0
            assert abs(got[i][column] - true) < 0.25
    assert fingerprint.edit_report(empty(spark)).count() == 0
    assert {r["fingerprint"] for r in fingerprint.fingerprints(df).collect()} == set(by_text.values())


@pytest.mark.parametrize("operator", ["op1", "op7"])
def test_near_family(spark, docs, operator):
    """The classes of a family of texts, many of which are just under the threshold to most others, against all pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(160)]
    family = []
    for k in range(150):
        w = list(base)
        for x in rng.sample(range(160), 1 + k % 5):
            w[x] = f"v{k // 2}{x}"
        family.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame([(i, t, "i", "t", 1) for i, t in family], SCHEMA)
    if operator == "op1":
        want, got = {i: c for (i, _), c in near_groups(family).items()}, {r["doc_id"]: r["class_id"] for r in icws.near_duplicate_classes(df).collect()}
    else:
        sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in family}
        want = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = sorted((want[a], want[b]))
                    want = {i: x if c == y else c for i, c in want.items()}
        got = {r["id"]: r["class_id"] for r in fingerprint.near_classes(df).collect()}
    assert got == want
    assert 10 < len(set(want.values())) < 140
    assert fingerprint.near_classes(empty(spark)).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title></head><body class="home"><nav>menu</nav><header>top</header><div class="cookie-notice">We use cookies</div>
    <main><article class="post-12"><h1>Head&amp;line</h1><p>One  two<b>three</b><br>four.<p>Next &eacute;&#8212;x<script>var a="</p>";</script><form>send</form>
    <aside>side</aside><ul><li>a<li>b</ul><div class="ad">buy</div><section id="comments"><p>first!</p></section></article></main><footer>end</footer></body></html>"""
    want = "Head&line One twothree four. Next é—x a b"
    rows = [(k, f"https://host.example/{k}", page.replace("post-12", f"post-{k}")) for k in range(5)] + [(9, None, None), (10, "x", ""), (11, "https://host.example/9", "<body>plain <i>text</i>"), (12, "https://host.example/10", "<article>cut off <p>in the mid")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k]["text"] for k in range(5)] == [want] * 5 and got[0]["n_chars"] == len(want)
    assert [got[k]["text"] for k in (9, 10, 11, 12)] == ["", "", "plain text", "cut off in the mid"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        import html as std

        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        p = html.Page(r["html"])
        assert p.text(p.best()) == re.sub(r"\s+", " ", std.unescape(re.sub(r"<[^>]+>", " ", article))).strip()


def test_quality(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    model = quality.fit(df)
    kept = {r["doc_id"] for r in quality.keep_good(df, model).select("doc_id").collect()}
    scored = {r["doc_id"]: r["keep"] for r in quality.score(df, model).collect()}
    assert kept == {i for i, k in scored.items() if k}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.99 and sum(i not in kept for i in bad) / len(bad) > 0.95  # the labels were not used to fit
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "a text.")], "doc_id long, text string")
    assert all(r["keep"] for r in quality.score(odd, model).collect()) and quality.keep_good(odd).count() == 4
    assert quality.score(empty(spark)).count() == 0 == quality.keep_good(empty(spark)).count()


def test_chat(spark):
    rng = random.Random(4)
    bits = [*chat.CONTROL, "\\", "l", "<", "[", "]", "/s>", " ", "x", "\n", " [/INST]", "é🙂"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "", "]["]), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "no id"), (50, None, None, None), (50, 1, "assistant", "a"), (50, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, id long")
    digests = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    whole = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, body in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups[c].append((role or "", body or ""))
    assert set(digests) == set(groups)
    for c, turns in groups.items():
        learned = "".join(b for r, b in turns if r == "assistant")
        assert chat.read_back(whole[c]["formatted"]) == turns
        assert "".join(chat.unescape(whole[c]["formatted"][s["begin"] : s["end"]]) for s in whole[c]["spans"]) == learned
        d = digests[c]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(turns), len(learned), len(whole[c]["formatted"]))
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{b}\n" for r, b in turns).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.format_digests(df.limit(0)).count() == 0


def test_template_language():
    t = chat.Template("{% if 1 == 1 %}a{{ 'b' + 'c' | upper }}{% else %}no{% endif %}{% for m in messages %}{{ m.text | trim }}{% endfor %}")
    assert t.tree[0] == chat.Text("abC") and t.text([{"text": " x "}, {"text": "y"}])[0] == "abCxy"
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{% for %}", "{% if x %}", "{{ x | open }}", "{{ 'a }}", "{% end %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ missing }}").text([])


def test_sql_of_queries(spark, tmp_path):
    """The SQL texts give the queries' rows on a small table of odd texts."""
    import duckdb

    from factspark.llm import queries

    a, b, c = "One line of five words here.", "A second line that has more words in it!", "Third: is it repeated?"
    rows = [(1, f"{a}\n{b} {c}\n\n{c}"), (2, f"\n  \n{a}\n{b} {c}  \nown"), (3, None), (4, ""), (5, " \n "), (6, f"({a} \"{b}\" {c} {a} {b} {c}"), (7, "é" * 40 + a), (8, "x" + "é" * 40), (9, "k\nl\nk\nl\nk"), (10, "... !\n?")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "system", "a[TURN:]\\ b"), (1, 1, "user", None), (1, 2, "assistant", "</s><s>é"), (1, 3, "assistant", "x"), (2, 0, "user", "[[/INST]")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("op4_line_dedup", "op8_suffix_dedup", "op9_chat_format", "op10_span_dedup"):
        found = queries.QUERIES[name](spark, str(tmp_path))
        known = con.sql(queries.ORACLE[name])
        assert sorted(found.columns) == sorted(known.columns)
        assert sorted(map(tuple, found.select(*known.columns).collect())) == sorted(known.fetchall()), name
