"""Operators and queries against plain versions."""

import hashlib
import io
import random
import re

import numpy as np
import pytest
from compare import assert_same

import __spark_entry__ as entry
from factmill.llm import decontaminate, graph, language, near, pieces, pii, queries, secret_scan, topk, toxicity, url_filter, warc
from factmill.llm.common import crc_mod, read


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in read(spark, small, "documents").collect()}


@pytest.fixture(scope="module")
def run(spark, small):
    held = {}

    def of(name):
        if name not in held:
            held[name] = entry.queries()[name](spark, small).toPandas()
        return held[name]

    return of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(run, small, name):
    assert_same(run(name), small, queries.ORACLE_SQL[name])


# --- pieces


def test_pieces_equal_the_library(run, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for r in run("op1_sentencepiece").itertuples():
        ids = sp.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids)))


def test_codec_on_odd_texts():
    c = pieces.Codec(pieces.model_path(), table_rows=50)
    rng = random.Random(1)
    parts = [*"ab cdé \n\t▁漢😀\x00'.", "the ", "  ", "ing", "   "]
    texts = ["", " ", "▁", "  ", "a", " a ", "x" * 500, *("".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(3000))]
    packed = c.encode(texts)
    for t, p, d in zip(texts, packed, c.decode(packed), strict=True):
        ids = c.sp.encode(t, add_bos=True, add_eos=True)
        assert p == np.array(ids, "<u4").tobytes() and d == c.sp.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert c.decode([np.array(ids, "<u4").tobytes()])[0] == c.sp.decode(ids)


# --- personal data and secrets


def base_pii(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * v, 10)) for v in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_pii(run, docs):
    for r in run("op2_pii").itertuples():
        want = base_pii(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == sha(text) and set(text.split(",")) - {""} <= set(r.spans.split(","))
        assert r.n_spans == len([x for x in r.spans.split(",") if x])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.BASE_KINDS]


def test_base_pii_on_odd_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        x = "".join(rng.choice("aB1@.+-_ (2)5.1") for _ in range(rng.randrange(40)))
        assert base_pii(x) == pii.base_spans(x)


@pytest.fixture(scope="module")
def field():
    return pii.Field(pii.labelled_table())


def test_field_on_held_out_rows(field):
    table = pii.labelled_table(200, seed=99)
    got = field.decode([field.classes(w) for w, _ in table])
    pairs = [(pii.LABELS[p], y) for (_, labels), g in zip(table, got, strict=True) for p, y in zip(g, labels, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98


def test_viterbi_is_the_best_path(field):
    import itertools

    rng = random.Random(2)
    for _ in range(20):
        x = [rng.randrange(field.size) for _ in range(4)]
        e = [field.w[0][b] + field.w[1][c] + field.w[2][a] for b, c, a in zip([0, *x], x, [*x[1:], 0])]
        score = lambda p: sum(e[i][v] for i, v in enumerate(p)) + sum(field.w[3][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
        assert score(field.decode([x])[0]) == pytest.approx(score(best))
        if not field.possible(np.array(x)):
            assert set(best) == {0}


def test_added_spans(field):
    text = "Please call Mr. John Smith at once. Tel: 555-123-4567\nSSN 123-45-6789. Done"
    got = pii.find([text], pii.Tagger(field))[0]
    assert [(k, text[a:b]) for k, a, b in got] == [("name", "John Smith"), ("tel", "555-123-4567"), ("natid", "123-45-6789")]


def base_secrets(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", x) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[n], a, b) for a, n, b in sorted(out)]


def test_base_secrets(run, docs):
    for r in run("op10_secrets").itertuples():
        want = base_secrets(docs[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for x, _, _ in want) for k in ("assign", "access", "hex")]


def test_secrets_on_odd_texts():
    rng = random.Random(4)
    parts = ["password", "PassWD", "ſecret", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "=token:", "x.y-z/w+v=u_tsr"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    got = secret_scan.Scanner(secret_scan.BASE_RULES).scan(texts)
    assert got == [base_secrets(x) for x in texts]


def test_trigram_queries_are_mandatory():
    assert secret_scan.trigram_query("[0-9a-f]{16,}") is True and secret_scan.trigram_query("a.c|xyz") is True

    def holds(query, s):
        if query is True or isinstance(query, bytes):
            return query is True or query in s
        return (all if query[0] == "and" else any)(holds(q, s) for q in query[1])

    for pattern, matches in {"abcd?e+fgh": ["abcefgh", "abcdeefgh"], "(?:foo|ba+r)[xy]zz": ["fooxzz", "baaaryzz"], "(?i)(key|pass)word=[0-9]+": ["KEYword=1", "passWORD=22"]}.items():
        query = secret_scan.trigram_query(pattern)
        assert query is not True and all(re.fullmatch(pattern, m) and holds(query, m.lower().encode()) for m in matches)
        assert not holds(query, b"nothing of it")
    pem = secret_scan.Scanner(secret_scan.RULES).scan(["x -----BEGIN RSA PRIVATE KEY----- y ghp_" + "Zq9" * 13])[0]
    assert [k for k, _, _ in pem] == ["pem", "forge"]


def test_redaction():
    assert secret_scan.redact("ab token=x cd", [("assign", 3, 10), ("hex", 5, 10)]) == "ab [assign] cd"


# --- decontamination


def test_decontamination(run, docs, spark, small):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = {}
    for r in read(spark, small, "benchmark").collect():
        w = words(r["text"] or "")
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(r["item_id"])
    for r in run("op7_decontamination").itertuples():
        w, hit, items = words(docs[r.doc_id]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= own
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit) and 20 * len(hit) >= len(w))


def test_wu_manber_on_small_alphabets():
    rng = random.Random(4)
    for _ in range(400):
        letters = ["a", "b", "c", "dd", "é"][: rng.randrange(2, 6)]
        text = lambda n: " ".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        items = {i: text(rng.choice([0, 1, 2, 3, 5, 13, 14, 20])) for i in range(rng.randrange(1, 4))}
        windows = {}
        for i, t in items.items():
            for w in decontaminate.windows_of(decontaminate.words_of(t)):
                windows.setdefault(w, []).append(i)
        texts = [text(rng.choice([0, 1, 5, 30, 600])) + " " + items[0], text(1100)]
        for t, (n, starts, ends, own) in zip(texts, decontaminate.Searcher([decontaminate.Patterns.unpacked(decontaminate.Patterns(windows).packed())]).search(texts), strict=True):
            w, hit, want = decontaminate.words_of(t), set(), set()
            for x, o in windows.items():
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        hit.update(range(i, i + len(x)))
                        want.update(o)
            assert n == len(w) and {k for a, b in zip(starts, ends) for k in range(a, b)} == hit and set(own) == want


@pytest.mark.parametrize("most", [1, 7, 60])
def test_several_tables_give_the_same(spark, small, most):
    d, b = read(spark, small, "documents"), read(spark, small, "benchmark")
    b = b if most > 1 else b.limit(2)
    one, many = (sorted(map(str, decontaminate.find(d, b, most_windows=n).collect())) for n in (10**6, most))
    assert one == many
    docs = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (1, "a b c x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (2, "x y z"), (None, "c x")], "item_id long, text string")
    for n in (1, 10**6):
        got = sorted((r["items"], r["starts"], r["ends"]) for r in decontaminate.find(docs, items, most_windows=n).collect())
        assert got == [([1], [0], [3]), ([1, 2], [0], [6]), ([2], [0], [3])]


# --- near duplicates


def test_near_duplicates(run, docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + 2]) for j in range(max(1, len(w) - 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    for r in run("op9_near_duplicates").itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_large_group_of_near_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 40)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    s = {i: {tuple(x) for x in zip(t.split(), t.split()[1:])} for i, t in rows}
    label = {i: i for i in s}
    for _ in range(10):
        for a in s:
            for b in range(a):
                if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(150)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(70):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def brute_components(texts, size=2):
    """Components by plain sets; only pairs whose sizes allow a link are compared."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            if root(a) != root(b):
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: root(i) for i in sets}


def test_near_duplicates_of_a_thousand_documents(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute_components({r["doc_id"]: r["text"] or "" for r in df.collect()})
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("bits, bucket, rows, pivots", [(-1, 128, 2048, 64), (-1, 4, 2048, 64), (16, 128, 7, 1), (-1, 128, 7, 3)])
def test_chains_of_near_copies(spark, monkeypatch, bits, bucket, rows, pivots):
    """Chains whose neighbours alone are linked, over compared and large buckets, several blocks and few pivots."""
    for k, v in {"FAR_BITS": bits, "BUCKET": bucket, "BLOCK_ROWS": rows, "PIVOTS": pivots}.items():
        monkeypatch.setattr(near, k, v)
    rng = random.Random(11)
    texts, n = {}, 0
    for _ in range(3):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(25):
            w = list(w)
            for _ in range(rng.choice([2, 3, 5])):
                w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
            texts[n] = " ".join(w)
            n += 1
    ids = list(texts)
    rng.shuffle(ids)
    texts = {i: texts[k] for i, k in zip(ids, texts)}
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_components(texts)
    assert got == want and 3 <= len(set(want.values())) < 40


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_with_centres_of_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    edges = [(1000, 2000 + i) for i in range(900)] + [(5, 1000), (3, 5)] + [(2500, 7000 + i) for i in range(500)] + [(9000, 9001 + i) for i in range(400)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for e in edges[:1402] for x in e} == {3} and {got[x] for e in edges[1402:] for x in e} == {9000}


def test_pigeonhole_guarantee():
    keys = lambda s: {(c, out, tuple(v for p, v in enumerate(s[c * near.PLACES : (c + 1) * near.PLACES]) if p != out)) for c in range(near.CHUNKS) for out in range(near.PLACES)}
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randrange(1000) for _ in range(near.SYMBOLS)]
        b = list(a)
        for p in rng.sample(range(near.SYMBOLS), near.CHUNKS * (near.ERRORS + 1) - 1):
            b[p] = -1
        assert keys(a) & keys(b)


# --- search


def test_topk_in_small_tiles(spark, small, monkeypatch):
    for k, v in {"SHARD_ROWS": 64, "BLOCK_ROWS": 8, "TASK_SHARDS": 1, "TASK_BLOCKS": 2, "FAN": 2, "TILE_ROWS": 3}.items():
        monkeypatch.setattr(topk, k, v)
    assert_same(topk.search(read(spark, small, "embeddings")).toPandas(), small, topk.OP3_SQL)


def test_big_integers():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 3.0], [2.0**40, 5.0], [1.0, 1.0]])
    place, score = topk._select(q, c, 2, np.array([-1]))
    assert place.tolist() == [[1, 0]] and score.tolist() == [[(1 << 63) - 1] * 2]


# --- labels


def plain_toxicity(examples, share, texts):
    """Scores from examples (id, text, label) by dense vectors, without any index: the same rules, written plainly."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))

    def bag(t):
        out = {}
        for w in words(t):
            w = b"<" + w.encode() + b">"
            for g in {w, *(w[i : i + 5] for i in range(len(w) - 4))} if len(w) > 5 else {w}:
                out[g] = out.get(g, 0) + 1
        return out

    bags, y = [bag(t) for _, t, _ in examples], np.array([v for _, _, v in examples])
    n, n1 = len(y), int(y.sum())
    df = {}
    for b, v in zip(bags, y):
        for g in b:
            df.setdefault(g, [0, 0])[v] += 1
    chi = {g: n * (q * (n - n1) - p * n1) ** 2 / ((p + q) * (n - p - q) * (n - n1) * n1) for g, (p, q) in df.items() if 5 <= p + q < n}
    rank = sorted(chi, key=lambda g: (-chi[g], g))
    from statistics import NormalDist

    limit = NormalDist().inv_cdf(1 - 0.01 / len(chi) / 2) ** 2
    terms = [g for i, g in enumerate(rank) if (i < 100 or chi[g] >= limit) and chi[g] > 0]
    idf = {g: np.log((1 + n) / (1 + sum(df[g]))) + 1 for g in terms}

    def vector(b):
        v = np.array([(1 + np.log(b[g])) * idf[g] if g in b else 0.0 for g in terms])
        return v / np.linalg.norm(v) if v.any() else v

    x = np.array([vector(b) for b in bags])

    def vote(v, skip=None):
        order = sorted((-round(float(c), 9), examples[j][0], j) for j, c in enumerate(x @ v) if c > 0 and j != skip)[:31]
        w = [(-c) ** 4 for c, _, _ in order]
        return (sum(a for a, (_, _, j) in zip(w, order) if y[j]) + 0.05) / (sum(w) + 0.1) if order else None

    own = [vote(v, j) for j, v in enumerate(x)]
    weight = np.where(y == 1, share / n1, (1 - share) / (n - n1))
    bare = [j for j, v in enumerate(own) if v is None]
    none = (weight[bare] * y[bare]).sum() / weight[bare].sum() if bare else share
    pools = []
    for v, j in sorted((v, j) for j, v in enumerate(own) if v is not None):
        pools.append([weight[j], weight[j] * y[j], weight[j] * v])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at, to = [p[2] / p[0] for p in pools], [p[1] / p[0] for p in pools]
    return [none if (v := vote(vector(bag(t)))) is None else float(np.interp(v, at, to)) for t in texts]


def test_toxicity_equals_brute_force(run, spark):
    import zlib

    folder = small = "/root/testdata/sf0.01"
    frame = entry.queries()["op4_toxicity"](spark, small).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, folder, "documents").collect()}
    labelled = sorted((r["doc_id"], r["toxic"]) for r in read(spark, folder, "labels").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    assert max(len([1 for _, v in labelled if v == k]) for k in (0, 1)) <= toxicity.PER_LABEL  # the sample is all of them
    examples = [(i, texts[i], v) for i, v in labelled if i in texts and len(texts[i]) <= toxicity.FIT_CHARS]
    a, b = near.multipliers(64)
    sig = {i: near.signature(x, a, b) if len(x := near.Shingler().shingles(t)) else None for i, t, _ in examples}
    kept = []
    for e in examples:
        if sig[e[0]] is None or not any(k[2] == e[2] and sig[k[0]] is not None and (sig[k[0]] == sig[e[0]]).sum() >= 32 for k in kept):
            kept.append(e)
    assert len(kept) < len(examples)
    examples = kept
    want = plain_toxicity(examples, sum(v for _, v in labelled) / len(labelled), [texts[i] for i in frame.doc_id])
    assert np.abs(frame.score - np.array(want)).max() < 1e-6
    assert frame.score.between(0, 1).all() and (frame.predicted == (frame.score >= 0.3)).all() and frame.score.nunique() > 5


def test_nearest_examples_are_exact():
    rng = random.Random(12)
    word = lambda: rng.choice(["bad", "vile", "awful", "fine", "good", "plain", "thing", "house", "water", "tree", "stone", "light"])
    for k in (40, 700):
        texts = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(k)]
        index = toxicity.Index(list(range(k)), texts, [int("bad" in t or "vile" in t) for t in texts], 0.2)
        dense = np.zeros((k, len(index.terms)))
        for i, (at, v) in enumerate(index.vectors(texts)):
            dense[i, at] = v
        for i in range(0, k, 7):
            cos = dense[index.ids] @ dense[i]
            want = sorted((-round(c, 9), int(index.ids[p]), p) for p, c in enumerate(cos.tolist()) if c > 0)[: toxicity.NEAREST]
            place, got = index.nearest(*index.vectors([texts[i]])[0])
            assert place.tolist() == [p for _, _, p in want] and np.allclose(got, [-c for c, _, _ in want], atol=1e-8)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    frame = entry.queries()["op4_toxicity"](spark, folder).toPandas().merge(read(spark, folder, "labels").toPandas(), on="doc_id")
    held = frame[frame.held_out]
    hit = held[held.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.85 and (held[held.toxic == 1].predicted == 1).mean() > 0.85


def test_language_held_out(run, spark, small):
    frame = run("op5_language").merge(read(spark, small, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = frame[frame.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and frame.score.between(0, 1).all() and frame.rejected.mean() < 0.02
    model = language.Model(["the cat and the dog", "le chat et le chien"] * 3, ["en", "fr"] * 3)
    assert [x[0] for x in model.predict(["the dog", "le chien", "123 !?", None])] == ["en", "fr", "und", "und"]
    assert model.predict(["漢字漢字漢字"])[0][2]


def test_language_equals_brute_force(run, spark, small):
    """Predictions from whole texts by dictionaries of n-grams; the centroids are the model's, whose parts are tested below."""
    model = language.fit(read(spark, small, "documents").filter(crc_mod("doc_id", 5) != 0))
    place = {int(c): i for i, c in enumerate(model.codes)}
    for r in run("op5_language").merge(read(spark, small, "documents").select("doc_id", "text").toPandas(), on="doc_id").itertuples():
        text = r.text or ""
        raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (" " + text + " ").encode())
        v = np.zeros(len(place))
        for size, base in ((1, 0), (2, 256), (3, 65792)):
            for i in range(len(raw) - size + 1):
                code = int.from_bytes(raw[i : i + size], "big") + base
                if code in place:
                    v[place[code]] += 1
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * model.idf
        cos = model.centroids @ v / (np.linalg.norm(v) or 1)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            best = int(cos.argmax())
            assert r.score == pytest.approx(cos[best], abs=1e-5) and r.lang_pred in {model.langs[model.owner[j]] for j in np.flatnonzero(cos > cos[best] - 1e-5)}
            limit = model.limit[best] / (2 if len(text) < 64 else 1)
            assert abs(cos[best] - limit) < 1e-5 or r.rejected == (cos[best] < limit)


def test_short_texts_of_learned_languages_are_kept(spark):
    from pyspark.sql import functions as F

    docs = read(spark, "/root/testdata/sf0.1", "documents")
    model = language.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    found = language.identify(docs.filter((F.length("text") < 64) & F.col("text").rlike("[A-Za-z]{3}")), model).agg(F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert found[0] > 20 and found[1] < 0.1


def test_centroids_and_limits_are_those_of_the_sample():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("haus baum wasser licht" if i % 2 else "house tree water light").split()) for _ in range(20)) for i in range(60)]
    langs = ["de" if i % 2 else "en" for i in range(60)]
    model = language.Model(texts, langs)
    x = np.concatenate([v for v, _ in model.vectors(texts)])
    near = (x @ model.centroids.T).argmax(1)
    for j in range(len(model.centroids)):
        own = x[near == j]
        mean = own.mean(0)
        assert np.allclose(model.centroids[j], mean / np.linalg.norm(mean), atol=1e-4) and {langs[i] for i in np.flatnonzero(near == j)} == {model.langs[model.owner[j]]}
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)


# --- urls and archives


def test_colliding_digests_are_told_apart(tmp_path):
    entries = [url_filter.Entry(f"h{i}.com", "/", "block", False) for i in range(20)]
    array = url_filter.DigestArray(url_filter.build(entries, str(tmp_path))[0])
    assert (array.find([url_filter.key(False, f"h{i}.com", "/") for i in range(20)]) == 1).all() and (array.find([url_filter.key(False, "other.com", "/")]) == -1).all()
    forged = array.keys[3]
    assert array.find([url_filter.key(False, "other.com", "/")], digest=lambda _: int(forged))[0] == -1


def test_entries_in_several_arrays(spark):
    df = spark.createDataFrame([(1, "http://www.example.com/en/x"), (2, "http://a.example.com/en/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, shard_entries=2).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block")}


@pytest.mark.parametrize("shard", [1, 100])
def test_a_rule_and_a_listed_item_of_one_place(spark, shard):
    df = spark.createDataFrame([(1, "http://x.com/a"), (2, "http://y.com/a")], "page_id long, url string")
    rules = [url_filter.Entry("x.com", "/", "allow"), url_filter.Entry("y.com", "/", "block"), url_filter.Entry("y.com", "/", "allow")]
    listed = [url_filter.Entry("x.com", "/", "block", False)]
    got = sorted(tuple(r)[3:] for r in url_filter.filter_urls(df, rules=rules, block_list=listed, shard_entries=shard).collect())
    assert got == [("x.com/", "allow"), ("y.com/", "block")]


def test_foreign_archives(spark, tmp_path):
    import gzip

    raw = [warc.record({"record_id": f"<urn:page:{i}>", "record_type": t, "payload": b"p" * i}) for i, t in ((10, "response"), (20, "metadata"), (70_000, "response"))]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    df = warc.read_archives(spark, str(tmp_path), payload=True).filter("record_type = 'response'")
    assert sorted(len(r["payload"]) for r in df.collect()) == [10, 10, 70_000, 70_000]
    assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().split("RuntimeFilters")[0]


def test_archives_are_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CUT_BYTES", 2000)
    rng = random.Random(7)
    rows = [(f"<urn:page:{i}>", "response", bytes(rng.randrange(256) for _ in range(rng.randrange(900)))) for i in range(60)]
    path = f"file://{tmp_path}/w"
    writer = warc.WarcWriter({"path": path}, False)
    writer.commit([writer.write(iter([warc.pa.RecordBatch.from_pylist([{"record_id": i, "record_type": t, "payload": p} for i, t, p in rows])]))])
    for most in (1, 5000, 10**6):
        reader = warc.WarcReader({"path": path, "payload": "true", "partitionBytes": str(most)})
        parts = reader.partitions()
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert (len(parts) > 1) == (most < 10**6) and sorted((r["record_id"], r["payload"]) for r in got) == sorted((i, p) for i, _, p in rows)


def test_members_without_a_length_are_inflated_once(monkeypatch):
    import gzip

    data = gzip.compress(warc.record({"record_id": "1", "record_type": "response", "payload": random.Random(1).randbytes(5 << 20)})) * 2
    fed = []
    real = warc.zlib.decompressobj

    class Counted:
        def __init__(self, *a):
            self.z = real(*a)

        def decompress(self, x, *a):
            out = self.z.decompress(x, *a)
            fed.append(len(x) - len(self.z.unconsumed_tail))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert len(list(warc.records(io.BytesIO(data), True, lambda r: True, True))) == 2 and sum(fed) < 1.2 * len(data)


def test_only_possible_revisits_are_shuffled(spark, small):
    plan = warc.capture(read(spark, small, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    data = b"".join(warc.member(warc.record({"record_id": f"{i}", "record_type": "response", "payload": b"x" * 10**6})) for i in range(3))
    sizes = []
    real = warc.zlib.decompressobj

    class Counted:
        def __init__(self, *a):
            self.z = real(*a)

        def decompress(self, *a):
            out = self.z.decompress(*a)
            sizes.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    rows = list(warc.records(io.BytesIO(data), True, lambda r: r["record_id"] == "1", True))
    assert [len(r["payload"]) for r in rows] == [10**6] and sum(sizes) < 1.1e6


# --- pipeline


def test_pipeline(spark, small, run, docs):
    import corpus_pipeline

    found = run("pipeline")
    assert found.doc_id.is_unique and found.same_text.all() and 0 < len(found) < len(docs)
    d = read(spark, small, "documents")
    kept = corpus_pipeline.drop_near_duplicates(spark, d, small)
    words = {r["doc_id"]: r["text"].lower().split() for r in kept.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids = sorted(sets)
    assert not [1 for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    clean = corpus_pipeline.replace_secrets(spark, d, small).collect()
    assert all(not base_secrets(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean) and len(clean) == len(docs)


def test_decontaminated_texts_hold_no_window(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    d = read(spark, folder, "documents")
    windows = {w for r in read(spark, folder, "benchmark").collect() for w in decontaminate.windows_of(decontaminate.words_of(r["text"]))}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = decontaminate.words_of(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    kept = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, d, folder).collect()}
    assert kept == {r["doc_id"] for r in d.collect() if clean(r["text"])} and len(kept) < d.count()


def test_language_stage_keeps_what_is_near(spark, small):
    import corpus_pipeline

    d = read(spark, small, "documents")
    model = language.fit(d.filter(crc_mod("doc_id", 5) != 0))
    rows = d.select("doc_id", "text").collect()
    want = {r["doc_id"] for r, (_, _, rejected) in zip(rows, model.predict([r["text"] for r in rows])) if not rejected}
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, d, small).collect()} == want
