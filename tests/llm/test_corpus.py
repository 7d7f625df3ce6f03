"""Corpus operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandwork.llm import bpe, common, fingerprints, graph, jaccard, language, mixing, packing, pages, quality, ranks, sharding, tokencounts, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, label int"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = [sentence(rng.choice([3, 20, 60, 120])) for _ in range(40)]
NEAR = [BASE[i].rsplit(" ", 2)[0] + " changed end" for i in range(0, 40, 4)]
TEXTS = [*BASE, *NEAR, BASE[1], BASE[1], BASE[2].upper(), None, "", " \n\t ", "one", "x" * 70_000, "\n".join([BASE[3]] * 6), "ünï çödé ßtraße\x0bΣίσυφος 中文字 <|endoftext|>  a   b\n \nc"]
ROWS = [(i * 3, t, "en" if i % 2 else None, ["a", "b", None][i % 3], None, "x", 7, 1) for i, t in enumerate(TEXTS)] + [(6, TEXTS[2], None, None, 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers(name):
    own, r = bpe.Encoder(common.tokenizer_path(name)), random.Random(1)
    letters = "ab cÀé  \n\t\r.,!'s't0129ßΣİ中 \x1c\x85\xa0　᠎²½ñA_ǅ"
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, starts = own.encode(texts, 9)
    for i, e in enumerate(tokenizer(name).encode_batch(texts, add_special_tokens=False)):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*e.ids, 9], texts[i]
    assert own.encode([], 9)[0].tolist() == []


def test_packing(docs, empty):
    rows = packing.pieces(docs).collect()
    t = tokenizer("word_bpe_49k.json")
    expected = collections.Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected[(doc_id, len(ids), ids.tobytes())] += 1
    got = collections.defaultdict(list)
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0
        got[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found = collections.Counter()
    for doc_id, own in got.items():
        own.sort(key=lambda r: r["sequence_id"] & (1 << 59) - 1)
        joined = b""
        for r in own:
            assert r["start"] * 4 == len(joined)
            joined += bytes(r["ids"])
            if len(joined) == 4 * r["doc_tokens"]:
                found[(doc_id, r["doc_tokens"], joined)] += 1
                joined = b""
    assert found == expected and packing.pieces(empty).count() == 0


def test_wavelet(spark, docs, empty, tmp_path):
    t, start, expected = tokenizer("byte_bpe_50k.json"), 0, []
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, wavelet.digest(docs).collect())) == sorted(expected)
    assert wavelet.digest(empty).count() == 0
    folder = f"file://{tmp_path}"
    found = wavelet.read(wavelet.write(docs, folder, shard_ids=500), folder).select("doc_id", "start", "n_tokens").collect()
    assert sorted(map(tuple, found)) == sorted(x[:3] for x in expected) and list(tmp_path.glob("*.wvm"))
    a = np.random.default_rng(0).integers(0, 900, 150_000)
    s = wavelet.Shard(wavelet.encode(a, np.array([5, 9]), np.array([100_000, 50_000])))
    assert (s.ids() == a).all() and all(s.access(i) == a[i] for i in range(0, len(a), 7919))
    for token in (0, 77, 899, 5000):
        p = np.flatnonzero(a == token)
        assert s.count(token) == len(p) and s.count(token, 1000, 90_001) == (a[1000:90_001] == token).sum()
        assert [s.occurrence(token, k) for k in range(3)] == [int(p[k]) if k < len(p) else -1 for k in range(3)]
    assert wavelet.Shard(wavelet.encode(np.zeros(0, np.uint32), np.zeros(0, int), np.zeros(0, int))).ids().tolist() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_queries_ids_are_the_plain_calls(spark, tmp_path, name):
    from tokenizers import Tokenizer

    from strandwork.llm import queries

    plain = Tokenizer.from_file(common.tokenizer_path(name))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>Y <|ENDOFTEXT|>", "é中 <|endoftext|>\n\n  z <|endoftext|>", "plain text", None]
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 2 if name.startswith("word") else 0] for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    if name.startswith("word"):
        found = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in queries.op3_packing(spark, str(tmp_path)).collect()}
        cut = lambda x: zip(np.cumsum([0, *packing.lengths(len(x), 4096)]).tolist(), packing.lengths(len(x), 4096), strict=False)
        assert found == {(i, a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes())) for i, x in enumerate(expected) for a, n in cut(x)}
    else:
        found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op5_wavelet(spark, str(tmp_path)).collect()}
        assert found == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(expected)}


def counts(t):
    w = words(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdict(spark, docs, empty):
    found = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.scores(docs).collect()}
    expected = set()
    for i, t, *_ in ROWS:
        c = counts(t)
        expected.add((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert found == expected and quality.scores(empty).count() == 0 and quality.filter_docs(empty).count() == 0
    good = [(i, sentence(150) + ".") for i in range(80)]
    bad = [(100 + i, " ".join(w + "###" for w in sentence(150).split())) for i in range(12)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string")
    assert {r["doc_id"] for r in quality.filter_docs(both).collect()} == {i for i, _ in good}


def test_language(spark, docs, empty):
    kinds = {"en": "the of and to in is that it was for".split(), "fr": "le la les des et une dans que pour avec".split(), "el": "και το να με για από στο είναι".split()}
    r = random.Random(3)
    text = lambda k, n=40: " ".join(r.choice(kinds[k]) for _ in range(n))
    rows = [(i, text(k), k) for i, k in enumerate(r.choice(list(kinds)) for _ in range(300))]
    extra = [(1000, None, "en"), (1001, "123 ² ½!", "en"), (1002, text("en", 30) + " " + text("fr", 20), None), (None, text("fr"), None), (1003, "日本語", None)]
    table = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in language.predicted(table).collect()}
    assert all(found[i]["lang_pred"] == k for i, _, k in rows)
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002, None)] == ["und", "und", "en", "fr"]
    # a script that nothing showed: a learned language all the same, without a score
    assert found[1003]["lang_pred"] in kinds and found[1003]["score"] == 0
    assert 0.4 < found[1002]["score"] < 0.8
    model = language.fit(table)
    spans = language.label(table.filter("doc_id = 1002"), model, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and abs(spans[0]["end"] - len(rows[0][1].split())) >= 0
    assert language.predicted(empty).count() == 0 and language.filter_docs(docs, 0.5).columns == docs.columns
    # every path by brute force: the best of all sequences
    score = np.random.default_rng(1).normal(size=(6, 3)).astype(np.float32) * 3
    import itertools

    best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(score[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    assert tuple(language.viterbi(score, np.array([6]), 2.0)) == best


def test_language_of_few_documents(spark):
    kinds = {"en": "the of and to in is that it was for".split(), "fr": "le la les des et une dans que pour avec".split()}
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(kinds["fr" if i % 1000 == 1 else "en"]) for _ in range(40)), "fr" if i % 1000 == 1 else "en") for i in range(4000)]
    rare = [i for i, _, k in rows if k == "fr"]
    assert not all(zlib.crc32(str(i).encode()) % 4 == 2 for i in rare)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for fitted in (language.FIT_ROWS, 40):  # a sample of 40 of all rows would hardly hold one
        model = language.fit(table, fitted)
        found = {x["doc_id"]: x["lang_pred"] for x in language.label(table, model).collect()}
        assert model.languages == ["en", "fr"] and all(found[i] == k for i, _, k in rows)


def brute_components(rows, k, percent):
    lower = str.maketrans({i: i + 32 for i in range(65, 91)})
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = words((t or "").translate(lower))
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    like = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    for i in sets:
        for j in sets:
            if i < j and any(like(a, b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[0]), find(i)) for i, s in sets.items()}


def test_jaccard(spark, docs, empty):
    r = random.Random(8)
    chain = [BASE[5].split()]
    for _ in range(25):  # near copies of near copies
        w = list(chain[-1])
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
        chain.append(w)
    rows = ROWS + [(5000 - i, " ".join(w), *[None] * 6) for i, w in enumerate(chain)]
    table = spark.createDataFrame(rows, SCHEMA)
    for k, percent in ((4, 85),):
        found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.components(table, k, percent).collect()}
        assert found == brute_components(rows, k, percent)
    kept = [x["doc_id"] for x in jaccard.distinct_docs(table).collect()]
    assert set(kept) == {c for _, c in brute_components(rows, 5, 80).values()}
    assert jaccard.components(empty).count() == 0


def test_jaccard_without_ids(spark):
    alone = spark.createDataFrame([(None, BASE[0]), (None, BASE[0]), (1, BASE[0])], "doc_id long, text string")
    assert sorted(str(x["component_id"]) for x in jaccard.components(alone).collect()) == ["1", "None", "None"]


def test_graph(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_graph_of_long_paths_in_any_order(spark):
    shuffled, n = list(range(1000, 1400)), 150
    random.Random(6).shuffle(shuffled)
    descending = [0, *range(n - 1, 0, -1)]
    edges = [e for path in (shuffled, descending) for e in zip(path, path[1:], strict=False)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == dict.fromkeys(range(n), 0) | dict.fromkeys(shuffled, 1000)


def test_fingerprints(docs, empty):
    rows = sorted(ROWS, key=lambda r: (r[0], r[1] or ""))
    texts = [t or "" for _, t, *_ in rows]
    expected = collections.Counter()
    for i, (doc_id, *_) in enumerate(rows):
        t, m = texts[i], len(texts[i]) // 4
        changed = t[: len(t) - m] + texts[(i + 1) % len(rows)][:m]
        expected[(doc_id, len(t), hashlib.sha256(changed.encode()).hexdigest())] += 1
    found = fingerprints.compared(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
    of = {r["doc_id"]: r for r in found}
    at = lambda t: [doc_id for doc_id, x, *_ in ROWS if x == t]
    assert len({of[i]["fingerprint"] for i in at(BASE[1])}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fingerprints.compared(empty).count() == 0
    sig = fingerprints.signatures([BASE[0], sentence(200), BASE[0]])
    assert fingerprints.likeness(sig[:1], sig[2:])[0] == 1 and fingerprints.likeness(sig[:1], sig[1:2])[0] < 0.2
    # the share of agreeing places estimates the Jaccard similarity
    w = sentence(400).split()
    a, b = fingerprints.signatures([" ".join(w), " ".join(w[:300] + sentence(100).split())])
    assert abs(float((a == b).mean()) - 296 / (396 + 396 - 296)) < 0.15


def test_near_duplicates_by_bands(spark, docs, empty):
    found = {r["doc_id"]: r["component_id"] for r in fingerprints.near_duplicates(docs).collect()}
    brute = brute_components([r for r in ROWS if len(words(r[1])) >= 5 or not words(r[1])], 5, 80)
    assert all(found[i] == c for i, (_, c) in brute.items())
    assert fingerprints.near_duplicates(empty).count() == 0


def test_sharding(spark, docs, empty):
    for shards in (1, 3, 24):
        found = sharding.assign(docs, shards).collect()
        assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in ROWS)
        size = {t or "": 0 for _, t, *_ in ROWS}
        for _, t, *_ in ROWS:
            size[t or ""] += len((t or "").encode()) + 8
        key = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)
        order = sorted(size, key=key)

        def walk(capacity, order=order, size=size):
            shard, held, out = 0, 0, {}
            for t in order:
                if held + size[t] > capacity:
                    shard, held = shard + 1, 0
                held += size[t]
                out[t] = shard
            return out

        low = max(size.values())
        while max(walk(low).values()) >= shards:
            low += 1
        best, of = walk(low), {r[0]: r[1] or "" for r in ROWS}
        assert {r["doc_id"]: r["shard"] for r in found} == {i: best[t] for i, t in of.items()}
        for s in {r["shard"] for r in found}:
            assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert sharding.digest(empty).count() == 0


def test_mixing(spark, docs, empty):
    found = mixing.digest(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((i, len(words(t))) for i, t, *_ in ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    of, taken, target = {i: s for i, _, _, s, *_ in ROWS}, collections.Counter(), {}
    for r in found:
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 8 for s, t in target.items())
    assert sorted(map(str, found)) == sorted(map(str, mixing.digest(docs).collect()))
    assert mixing.targets([100, 10, 90], [3, 1, 2]) == pytest.approx([168.0, 20.0, 112.0]) and mixing.digest(empty).count() == 0
    mixed = mixing.mixed(docs).collect()
    assert sum(len(words(r["text"])) for r in mixed) == sum(taken.values())
    assert all(any((t or "").startswith(r["text"]) for i, t, *_ in ROWS if i == r["doc_id"]) for r in mixed)


def test_mixing_with_sources_smaller_than_the_rest(spark):
    long = [(i, "a " * 100_000, "a") for i in range(40)]
    short = [(100 + i, " ".join(["b"] * n), "b") for i, n in enumerate((3, 0, 200, 97))] + [(200 + i, "c", "c") for i in range(5)] + [(300, "d d d", None)]
    found = mixing.schedule(spark.createDataFrame(long + short, "doc_id long, text string, source string")).collect()
    taken = {r["doc_id"]: r["taken"] for r in found}
    assert all(taken[i] == 2 * len(words(t)) for i, t, _ in short)
    total = {r["source_size"]: r["target"] for r in found}
    assert sum(taken[i] for i, *_ in long) == round(total[4_000_000]) == 4_000_308 * 3 // 2 - 2 * 308


def test_mixing_slots():
    for counts in ([300, 5, 0, 90, 1], [1], [0, 3], [7, 7, 7], [1000, 1]):
        n, slots = sum(counts), mixing.Slots(counts)
        of = [slots.source(i) for i in range(n)]
        assert [of.count(s) for s in range(len(counts))] == counts
        for k in range(n):
            assert all(abs(of[:k].count(s) - k * c / n) <= 2 + n.bit_length() / 2 for s, c in enumerate(counts))
        for s, c in enumerate(counts):
            assert slots.place(np.full(c, s), np.arange(c)).tolist() == [i for i in range(n) if of[i] == s]


def test_mix_by_simulation(spark, docs):
    """Every word of every slot by hand: what the mix takes, in which order."""
    block = 16
    found = mixing.schedule(docs, block=block).collect()
    by = collections.defaultdict(list)
    for i, t, _, s, *_ in ROWS:
        md5 = hashlib.md5(f"6|{i}".encode()).hexdigest()
        by[s].append((int(md5[:15], 16), i, t))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(t)) for *_, t in by[s]) for s in names]
    aims = mixing.targets(sizes, [3.0, 1.0, 2.0])
    counts = [-(-round(a) // block) for a in aims]
    slots, expected, taken = mixing.Slots(counts), [], collections.Counter()
    for s, name in enumerate(names):
        stream = [(i, w) for _, i, t in sorted(by[name], key=lambda x: x[:2]) for w in range(len(words(t)))]
        at = slots.place(np.full(counts[s], s), np.arange(counts[s]))
        for k in range(round(aims[s])):
            i, w = stream[k % len(stream)]
            taken[name, i] += 1
            if w == 0:
                expected.append((int(at[k // block]), k % block, i))
    assert sorted((x["slot"], x["offset"], r["doc_id"]) for r in found for x in r["starts"]) == sorted(expected)
    got = collections.Counter()
    for r in found:
        got[r["source"], r["doc_id"]] += r["taken"]
    assert +got == taken
    rows = mixing.mixed(docs, block=block).collect()
    assert [r["doc_id"] for r in rows] == [i for *_, i in sorted(expected)]
    assert sum(len(words(r["text"])) for r in rows) == sum(taken.values())
    odd = docs.select("*", *[docs["label"].alias(c) for c in ("hash", "doc", "k_id", "slots", "x.y")])
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0


def test_token_counts(docs, empty):
    scores = tokencounts.pieces(common.tokenizer_path("piece_bpe_32k.model"))

    def brute(w):
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            n = len(w[end - 1].encode())
            options = [(-(best[-1][0] + n * tokencounts.BYTE_SCORE), best[-1][1] + n)]
            options += [(-(best[b][0] + scores[w[b:end]]), best[b][1] + 1) for b in range(max(0, end - 40), end) if w[b:end] in scores]
            score, count = min(options)
            best.append((-score, count))
        return best[-1][1]

    found = collections.Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokencounts.counts(docs).collect())
    assert found == collections.Counter((i, len(words(t)), sum(brute("▁" + w) for w in words(t))) for i, t, *_ in ROWS)
    assert tokencounts.counts(empty).count() == 0


def test_ranks(spark):
    from pyspark.sql import functions as F

    rows = [(i % 3 if i % 7 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v long").withColumn("h", F.xxhash64("v"))
    found = ranks.before(df, ["g"], "h", ["v"], {"rank": F.lit(1), "total": F.col("v")}, 500).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["g"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["h"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [r["total"] for r in own] == [sum(x["v"] for x in own[:k]) for k in range(len(own))]


def page(body, n):
    return f"<html><head><title>t{n}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_pages(spark):
    article = "<nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>T &amp; {0}</h1><p>a  b\n<b>c<br>d<p>e{0}<div class=comments><p>nice</div></article><footer>&copy;</footer>"
    bare = "<div>Site name</div><p>Body {0}<p>More {0}</p><div>All rights kept</div>"
    rows = [(i, f"http://h.example/{'x' * i}", page(article.format(i), i)) for i in range(5)]
    rows += [(10 + i, f"http://bare.example/p/{i}.html?q", page(bare.format(i), i)) for i in range(40)]
    rows += [(90, None, None), (91, "::bad", ""), (None, "http://h.example/", "<p>only<script>x</script>"), (92, "http://solo.example/", page(bare.format(7), 7)), (93, "http://c.example/1", page("<p>same", 1)), (94, "http://c.example/2", page("<p>same", 1))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r for r in pages.main_text(table).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["text"] == f"T & {i}\na b c d\ne{i}" for i in range(5))
    assert all(found[10 + i]["text"] == f"Body {i}\nMore {i}" for i in range(40))
    assert found[90]["text"] == found[91]["text"] == "" and found[None]["text"] == "only" and found[93]["text"] == found[94]["text"] == "same"
    assert found[92]["text"].startswith("Site name") and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert pages.main_text(table.limit(0)).count() == 0


def brute_text(rows):
    """Each page's text from all pages at once: the nearest four before and after it on its host, by the rule in the module's docstring."""
    read = []
    for page_id, url, text in rows:
        own = pages.lines(text)
        read.append(((*pages.address(url), -(1 << 63) if page_id is None else page_id), page_id, own))
    read.sort(key=lambda r: r[0])
    out = {}
    for at, (key, page_id, own) in enumerate(read):
        near = [read[j][2] for j in range(max(0, at - 4), min(len(read), at + 5)) if j != at and read[j][0][0] == key[0]]
        mine = {t for t, p in own if p > pages.BOILER}
        others = [o for o in near if not (mine <= {t for t, p in o if p > pages.BOILER} or {t for t, p in o if p > pages.BOILER} <= mine and any(p > pages.BOILER for _, p in o))]
        hits = collections.Counter(i for o in others for i in pages.common_lines([t for t, _ in own], [t for t, _ in o]))
        rest = [(t, p) for i, (t, p) in enumerate(own) if not (hits[i] and p < pages.MAIN)]
        least = pages.CALLED if any(p >= pages.CALLED for _, p in rest) else pages.BARE
        out[page_id] = "\n".join(t for t, p in rest if p >= least)
    return out


def test_pages_by_brute_force_for_any_number_of_partitions(spark):
    r = random.Random(12)
    menus, passages = [sentence(3) for _ in range(6)], [sentence(12) for _ in range(5)]
    rows = []
    for i in range(300):
        lines = [r.choice(menus), r.choice(menus), *(r.choice([sentence(9), r.choice(passages)]) for _ in range(r.randint(1, 4))), "All rights kept", *[r.choice(menus)] * r.randint(0, 2)]
        body = "".join(f"<div>{x}</div>" for x in lines)
        if r.random() < 0.5:
            body += f"<article><p>{sentence(9)}<p>{r.choice(passages)}<p>Read on</article>"
        rows.append((i, f"http://{r.choice('aab')}.example/{r.randint(0, 150)}", page(body, i)))
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(0, 300, 7)]
    expected, kept = brute_text(rows), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = {x["page_id"]: x for x in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
            assert {i: x["text"] for i, x in found.items()} == expected
            assert sum(x["n_shared"] for x in found.values()) > 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_page_structure():
    text = lambda body: pages.kept(own := pages.lines(body), [t for t, _ in own], [])[0]
    assert text("<main><p>Whole story</p><article>Teaser</article></main>") == "Whole story\nTeaser"
    assert text("<article><p class='share-price'>Up<p id=reply-to-critics>No<div class='comment-list'>Hi</div><div id=shareButtons>x</div></article>") == "Up\nNo"
    assert text("<p>a<svg><p>b<svg>" * 3) == "\n".join("ab" * 3)
    long = "<svg><p>x " * 40_000
    assert len(pages.lines(long)) == 40_000


def test_longest_common_lines():
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(pages.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(y == a[i] for y in rest) for i in found)
