"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, and against brute force."""

import base64
import bz2
import gzip
import io
import itertools
import lzma
import math
import tarfile
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, components, exact_dedup, fingerprint, html_text, language_id, license_scan, line_dedup, near_dedup, packing, secrets
from quillon.llm.catalogue import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, id string, node string, owner string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
ALPHA = "the river ran past the old mill and the miller sang to his mules every single morning before dawn broke"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "k", "i", "n", "o") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    near = ALPHA.replace("dawn", "noon")
    rows = [(1, ALPHA, "en", "a"), (2, ALPHA, "en", None), (2, ALPHA, "en", None), (3, near, "en", "b"), (4, None, "en", "a"), (5, "", "de", "a"), (None, "der Hund und die Katze", "de", "b"), (7, LONG, None, "c"), (8, "  \n\t ", None, None), (None, None, None, None)]
    return docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).cache()


OPERATORS = {
    "near": near_dedup.near_duplicates,
    "near_drop": near_dedup.drop_near_duplicates,
    "fingerprint": fingerprint.fingerprints,
    "language": language_id.identify,
    "language_keep": language_id.keep_identified,
    "bpe": bpe.encode,
    "packing": packing.pack,
    "secrets": secrets.secret_scan,
    "redact": secrets.redact_secrets,
    "lines": line_dedup.drop_widespread_lines,
    "html": lambda d: html_text.extract(d, "doc_id", "text"),
    "exact": exact_dedup.exact_duplicates,
    "exact_drop": exact_dedup.drop_exact_duplicates,
    "license": license_scan.license_scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, none):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", ["fingerprint", "language", "bpe", "redact", "lines", "html"])
def test_a_row_for_every_row(name, odd):
    assert OPERATORS[name](odd).count() == odd.count()


def test_odd_rows(odd):
    """Nulls, empty and blank texts, a very long one and repeated rows have the results that the docstrings tell."""
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    lengths = {(r["doc_id"], r["n_units"]) for r in fingerprint.fingerprints(odd).collect()}
    assert lengths == {(i, None if t is None else len(t)) for i, t in texts}
    language = language_id.identify(odd, per_class=5).collect()
    assert all((r["language"] is None) == (r["confidence"] is None) for r in language)
    assert sum(r["language"] is None for r in language) == sum(not (t or "").strip() for _, t in texts)
    kept = language_id.keep_identified(odd, least=0.0, per_class=5)
    assert kept.columns == odd.columns and kept.count() == sum(bool((t or "").strip()) for _, t in texts)
    encoded = {(r["doc_id"], r["n_bytes"], r["n_tokens"] is None, r["tokens"] is None) for r in bpe.encode(odd).collect()}
    assert encoded == {(i, None if t is None else len(t.encode()), t is None, t is None) for i, t in texts}
    assert secrets.secret_scan(odd).count() == 0 and license_scan.license_scan(odd).count() == 0
    assert sorted(map(str, secrets.redact_secrets(odd).collect())) == sorted(map(str, odd.collect()))
    assert {r["n_removed"] for r in line_dedup.drop_widespread_lines(odd, min_sites=2).collect()} == {0}  # a null site is none
    lines = line_dedup.drop_widespread_lines(odd, min_sites=1).collect()
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t if t is None or not t.strip() else "" for i, t in texts} | {8: "  \n\t "}
    assert sum(r["n_removed"] for r in lines) == 6


def test_no_labels_no_model(spark, odd):
    """A table whose labels are all null has no classifier: nothing is identified, so nothing is kept."""
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["language"] for r in language_id.identify(bare).collect()} == {None}
    assert language_id.keep_identified(bare).count() == 0


CLASHES = ["language", "confidence", "block", "range", "weight", "site", "line", "gone", "kept", "spans", "votes", "tokens", "_word", "_bits", "m", "n", "node", "root", "entries", "_quillon_a"]


@pytest.mark.parametrize("name", ["near_drop", "exact_drop", "language_keep", "redact"])
def test_clashing_names(name, odd):
    """Filters give back every column, whatever its name."""
    wide = odd.select("*", *(F.lit(c).alias(c) for c in CLASHES if c not in odd.columns))
    out = OPERATORS[name](wide)
    assert out.columns == wide.columns and out.count() == OPERATORS[name](odd).count()
    assert out.select(*CLASHES).distinct().count() <= 1


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("near_drop", "exact_drop", "language_keep", "redact")])
def test_clashing_names_are_not_read(name, odd):
    wide = odd.select("doc_id", "text", "lang", "source", *(F.lit(1).alias(c) for c in CLASHES))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(OPERATORS[name](wide)) == order(OPERATORS[name](odd))


def test_near_groups(odd):
    found = sorted((r["doc_id"], r["kept_id"]) for r in near_dedup.near_duplicates(odd).collect())
    assert found == [(2, 1), (2, 1), (3, 1)]
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 7


def test_exact_groups(odd):
    assert sorted((r["doc_id"], r["kept_id"]) for r in exact_dedup.exact_duplicates(odd).collect()) == [(2, 1), (2, 1)]
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert exact_dedup.exact_duplicates(odd, capacity=1).count() == 2


def test_directory_doubles():
    keys = {0x00: 5, 0x10: 5, 0xF0: 1, 0xF1: 9}

    def sizes(d, parents):
        out = {}
        for k, n in keys.items():
            out.setdefault(k << 8 >> (16 - d), []).append(n)
        return {p: (sum(n), len(n)) for p, n in out.items()}

    depth, buckets = exact_dedup.directory(sizes, 5, 16)
    assert depth == 8 and sum(n for *_, n in buckets) == 20
    assert [b[2] for b in buckets if b[2]] == [5, 5, 1, 9]  # a bucket of one key does not split
    ranges = [(p << (16 - d), (p + 1) << (16 - d)) for p, d, _ in buckets]
    assert ranges[0][0] == 0 and ranges[-1][1] == 1 << 16 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    at = exact_dedup.slot(buckets, np.array([k << 8 for k in keys], np.uint64), 16)
    assert all(ranges[i][0] <= k << 8 < ranges[i][1] for i, k in zip(at, keys))
    assert exact_dedup.owners([(0, 2, 5), (1, 2, 5), (1, 1, 1)], 6) == [0, 1, 1]
    assert exact_dedup.directory(lambda d, parents: {}, 5) == (0, [(0, 0, 0)])


def test_texts_of_one_key_are_chained(spark, monkeypatch):
    """With keys of a few bits, most texts share theirs with others: only bytes tell them apart."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(int(i), f"text {rng.integers(60)}", "en", "s") for i in rng.permutation(300)] + [(None, "text 5", "en", "s"), (7000, None, "en", "s")]
    table = docs(spark, rows)
    few = lambda text: (F.pmod(F.xxhash64(text), F.lit(5)), F.lit(0).cast("long"))
    monkeypatch.setattr("quillon.llm._rows.text_keys", few)
    first = {}
    for i, t, *_ in rows:
        if t is not None:
            first[t] = min((x for x in (first.get(t), i) if x is not None), default=None)
    want = sorted((i, first[t]) for i, t, *_ in rows if t is not None and i != first[t] and i is not None)
    found = [tuple(r) for r in exact_dedup.exact_duplicates(table, capacity=50).collect()]
    assert sorted(x for x in found if x[0] is not None) == want and [x for x in found if x[0] is None] == [(None, first["text 5"])]


def test_near_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, int(rng.integers(40, 200)))) for _ in range(40)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(int(rng.integers(0, 3))):
            c = list(b)
            for i in rng.choice(len(c), max(1, len(c) // 40)):
                c[i] = str(rng.choice(words))
            texts.append(c)
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    truth = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b])}
    root = list(range(len(texts)))
    for a, b in sorted(truth):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    want = {(i, r) for i, r in enumerate(root) if r != i}
    found = {tuple(r) for r in near_dedup.near_duplicates(docs(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])).collect()}
    assert len(found & want) >= 0.9 * len(want) and not found - want


def test_near_short_texts_are_all_found(spark):
    """Sets that their sketch holds whole lose no pair."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.choice(400, int(rng.integers(3, 34)), replace=False)]
        texts += [base, base[: max(1, len(base) - int(rng.integers(0, 9)))]]
    sets = [{tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    want = {(i, r) for i, r in enumerate(root) if r != i}
    found = {tuple(r) for r in near_dedup.near_duplicates(docs(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])).collect()}
    assert found == want


def test_near_texts_that_share_a_passage(spark, monkeypatch):
    """Texts that have a passage in common, 45 % of each, and no more are no copies, and their pairs are not all tried."""
    passage = [f"p{i}" for i in range(90)]
    texts = [passage + [f"w{i}x{j}" for j in range(110)] for i in range(400)]
    texts += [t[:-4] + ["other", "words"] for t in texts[:20]]
    tried, compare = [], near_dedup._Search.compare
    monkeypatch.setattr(near_dedup._Search, "compare", lambda self, pairs: tried.append(compare(self, pairs)) or tried[-1])
    found = {tuple(r) for r in near_dedup.near_duplicates(docs(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])).collect()}
    assert found == {(400 + i, i) for i in range(20)}
    assert sum(n for _, n in tried) < 8000  # of 88,000


def test_near_hot_values_count_alike(spark, monkeypatch):
    """Whether a value counts as hot changes the way it is counted by and no result."""
    found = []
    for hot in ("v", "v % 2 = 0", "false"):
        monkeypatch.setattr(near_dedup._Search, "_hot", lambda self, hot=hot: self.nodes.select(F.explode("least").alias("v")).distinct().where("true" if hot == "v" else hot))
        found.append(sorted(map(tuple, near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 25


def test_components_on_the_cluster(spark):
    """Star rounds and the union-find give the same roots, with loops, repeats and nulls among the edges."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 300, 260), rng.integers(0, 300, 260))] + [(5, 5), (7, 8), (7, 8), (None, 3)] + [(i, i + 1) for i in range(1000, 1040)]
    table = spark.createDataFrame(edges, "a long, b long")
    near = {tuple(r) for r in components.components(table).collect()}
    assert near == {tuple(r) for r in components.components(table, driver_edges=1).collect()} and (1040, 1000) in near
    assert components.components(table.limit(0)).count() == 0


def test_near_copies_between_a_half_and_more(spark):
    """The similarity asked for is 0.5 whatever the module says: copies with a passage added, 0.5 to 0.6 alike, and others below."""
    rows, want = [], set()
    for i in range(60):
        n, add = 120 + i, 0.72 + 0.2 * (i % 20) / 20 if i % 3 else 1.3
        base = [f"w{i}x{j}" for j in range(n)]
        copy = base + [f"v{i}x{j}" for j in range(int(n * add))]
        alike = (n - 2) / (len(copy) - 2)
        assert alike < 0.45 or 0.5 < alike < 0.6
        rows += [(2 * i, " ".join(base), "en", "s"), (2 * i + 1, " ".join(copy), "en", "s")]
        if alike > 0.5:
            want.add((2 * i + 1, 2 * i))
    found = {tuple(r) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert len(found & want) >= 0.9 * len(want) and not found - want


def test_fingerprint_spans():
    text = "abracadabra abracadabra x"
    p = fingerprint.Prefix(text)
    for a in range(len(text)):
        for b in range(len(text)):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert p.extension(a, b) == n
    rng = np.random.default_rng(1)
    for text in [text, *(" ".join(rng.choice(["a", "b", "ab"], int(rng.integers(2, 30)))) for _ in range(100))]:
        p = fingerprint.Prefix(text)
        starts = p.word_starts().tolist()
        spans = [(p.extension(a, b), -b, -a) for a in starts for b in starts if a < b]
        length, b, a = max(spans)  # the longest; of these the least second place, then the least first
        assert p.longest_repeat() == ((length, -a, -b) if length else (0, 0, 0)), text
    assert fingerprint.Prefix("").longest_repeat() == (0, 0, 0)


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(table.where("doc_id % 2 = 0"), per_class=100, epochs=2)
    scored = language_id.score(table.where("doc_id % 2 = 1"), model).where("language IS NOT NULL")
    n, good = scored.selectExpr("count(*)", "count_if(language = lang)").first()
    assert good / n > 0.9
    assert (model.weights == 0).mean() > 0.3


def _scalar_features(text):
    """Counts of hashed n-grams of 1 to 3 characters, one at a time."""
    mask = (1 << 64) - 1
    letter = lambda c: (97 <= c <= 122 or c >= 170) and not 0x2000 <= c <= 0x2BFF and c not in (0xD7, 0xF7, 171, 187, 191)
    units = [ord(c) for c in text.replace("\0", " ").lower()]
    kept = [u if letter(u) else 32 for i, u in enumerate(units) if letter(u) or (i and letter(units[i - 1]))] + [32]
    out = {}
    for k in (1, 2, 3):
        for i in range(len(kept) - k + 1):
            gram = kept[i : i + k]
            if all(u == 32 for u in gram):
                continue
            h = k
            for u in gram:
                h = (h * 0x100000001B3 + u) & mask
            x = h
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> shift)) * by & mask
            f = (x ^ (x >> 31)) >> (64 - language_id.BITS)
            out[f] = out.get(f, 0) + 1
    return out


def test_language_features_and_frequencies(spark):
    texts = ["Der Hund, die Katze!", "a", "", "  12 ab--cd ", "Ça va? Où?", "日本 語", "x" * 50, "İi"]
    found = {}
    for first, row, feature, count in language_id._counts(pa.array(texts)):
        for r, f, c in zip(row.tolist(), feature.tolist(), count.tolist()):
            found.setdefault(first + r, {})[f] = c
    want = {i: x for i, t in enumerate(texts) if (x := _scalar_features(t))}
    assert found == want
    df, n = language_id._document_frequency(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    assert n == len(want) and {int(f): int(df[f]) for f in np.flatnonzero(df)} == dict(Counter(f for x in want.values() for f in x))
    idf = np.linspace(1, 3, language_id.FEATURES)
    for x in want.values():
        f, c = np.array(list(x)), np.array(list(x.values()))
        raw = [(1 + math.log(n)) * idf[i] for i, n in x.items()]
        size = math.sqrt(sum(v * v for v in raw))
        assert np.allclose(language_id._tfidf(np.zeros(len(f), int), f, c, 1, idf), [v / size for v in raw])


def test_ftrl_and_temperature_against_scalars():
    rng = np.random.default_rng(12)
    ftrl = language_id.Ftrl(6, 3, alpha=0.7, beta=0.5, l1=0.05, l2=0.1)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(i, c):
        l1, l2 = (0.05, 0.1) if i < 6 else (0, 0)  # the bias is not penalised
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - math.copysign(l1, z[i][c])) / ((0.5 + math.sqrt(n[i][c])) / 0.7 + l2)

    for _ in range(25):
        x = np.concatenate([rng.random((4, 6)) * (rng.random((4, 6)) < 0.5), np.ones((4, 1))], 1)
        y = rng.integers(0, 3, 4)
        ftrl.step(x, y)
        w = [[weight(i, c) for c in range(3)] for i in range(7)]
        g = [[0.0] * 3 for _ in range(7)]
        for row, label in zip(x, y):
            e = [math.exp(sum(row[i] * w[i][c] for i in range(7))) for c in range(3)]
            for c in range(3):
                for i in range(7):
                    g[i][c] += (e[c] / sum(e) - (c == label)) * row[i] / 4
        for i in range(7):
            for c in range(3):
                sigma = (math.sqrt(n[i][c] + g[i][c] ** 2) - math.sqrt(n[i][c])) / 0.7
                z[i][c] += g[i][c] - sigma * w[i][c]
                n[i][c] += g[i][c] ** 2
    assert np.allclose(ftrl.weights(), [[weight(i, c) for c in range(3)] for i in range(7)])
    logits, y = rng.normal(size=(200, 3)) * 4, rng.integers(0, 3, 200)
    y[:120] = logits[:120].argmax(1)
    loss = lambda t: -sum(math.log(math.exp(r[k] / t) / sum(math.exp(v / t) for v in r)) for r, k in zip(logits, y))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 400))
    best = min(grid, key=loss)
    assert abs(math.log(language_id.fit_temperature(logits, y) / best)) < 0.02


def test_bpe_round_trip_and_reference(spark, odd):
    import tiktoken

    ours = bpe.vocabulary(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    for text in ["", "a", "hello  world\n\n", "naïve Straße 日本語 🙂", "a" * 1000, "<|endoftext|>", LONG[:5000]]:
        assert ours.encode(text) == other.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text
    rng = np.random.default_rng(7)
    for _ in range(60):  # pieces beyond the widest bucket, of parts that make pairs of lower rank as they merge
        text = "".join(rng.choice(["th", "e", "in", "ing", "er", "an", "s", "aa", "qX", "é"], int(rng.integers(150, 900))))
        assert ours.encode(text) == other.encode_ordinary(text)
        assert ours._row(text.encode()).tolist() == other.encode_ordinary(text)
    for text in ("ab" * 40_000, "-" * 5000 + "=" * 999, base64.b64encode(rng.bytes(30_000)).decode()):
        assert ours.encode(text) == other.encode_ordinary(text)
    encoded = bpe.encode(odd)
    assert encoded.where("NOT round_trip").count() == 0
    texts = {r["text"] for r in bpe.decode(encoded).collect()}
    assert texts == {r["text"] for r in odd.select("text").collect()}


def test_packing_is_the_least(spark):
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        position = np.cumsum(rng.integers(1, 6, n)).tolist()
        penalty = rng.integers(0, 4, n).tolist()
        best = None
        for mask in range(1 << (n - 1)):
            at = [i for i in range(n - 1) if mask >> i & 1] + [n - 1]
            ends = [0] + [position[i] for i in at]
            if max(b - a for a, b in zip(ends, ends[1:])) > 6:
                continue
            cost = sum(6 - (b - a) for a, b in zip(ends, ends[1:])) + sum(penalty[i] for i in at)
            best = cost if best is None else min(best, cost)
        at = packing.cuts(position, penalty, 6)
        ends = [0] + [position[i] for i in at]
        assert sum(6 - (b - a) for a, b in zip(ends, ends[1:])) + sum(penalty[i] for i in at) == best


def test_packing_holds_every_word(spark, odd):
    words = sum(len((r["text"] or "").split()) for r in odd.select("text").collect())
    for window, block in ((512, 5000), (64, 40), (1024, 1 << 19)):
        rows = packing.pack(odd, window=window, block_words=block).collect()
        assert sum(r["n_words"] for r in rows) == words
        assert all(r["n_words"] == sum(p["last"] - p["first"] for p in r["parts"]) == sum(len(p["text"].split()) for p in r["parts"]) <= window for r in rows)
        assert len({(r["block"], r["window"]) for r in rows}) == len(rows)
        assert rebuilt(rows) == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in odd.collect() if (r["text"] or "").strip())


def rebuilt(rows):
    """(id is not null, id, text) of every document that the windows hold, by their parts alone."""
    parts = {}
    for r in sorted(rows, key=lambda r: (r["block"], r["window"])):
        for p in r["parts"]:
            whole = parts.setdefault((p["place"], p["doc_id"]), [])
            assert p["first"] == (whole[-1]["last"] if whole else 0)
            whole.append(p)
    return sorted((i is not None, i or 0, "".join(p["text"] for p in whole)) for (_, i), whole in parts.items())


def test_packing_does_not_depend_on_tasks(spark):
    """Blocks are those of the stream, whatever the number of tasks; ids may be strings."""
    rng = np.random.default_rng(9)
    rows = [(f"é{i}" if i % 3 else f"z{i}", " ".join(["w" * int(rng.integers(1, 60)) + "." * (j % 7 == 0) for j in range(int(rng.integers(1, 90)))])) for i in range(300)]
    table = spark.createDataFrame([*rows, (None, "no id here")], "doc_id string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("2", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r["block"], r["window"], r["n_words"], str(r["parts"])) for r in packing.pack(table, window=100, block_words=1000).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0][0][3].find("no id here") > 0


KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


@pytest.mark.parametrize("wrap", [str, lambda s: base64.b64encode(f"the key is {s}".encode()).decode(), lambda s: quote(base64.b64encode(f"the key is {s}".encode()).decode(), safe=""), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s)])
def test_secrets_in_layers(wrap):
    hidden = wrap(KEY)
    text = f"before {hidden} after"
    found = [f for f in secrets.scan(text) if f[0] == "aws_access_key"]
    assert found and text[found[0][1] : found[0][2]] in hidden
    assert secrets.redact(text) == f"before {secrets.MASK} after"
    assert secrets.scan("nothing to see %41 here " + "abcd" * 10) == []


def test_secrets_that_repeat():
    blob = base64.b64encode(f"the key is {KEY}".encode()).decode()
    deep = base64.b64encode(gzip.compress(f"the key is {KEY}".encode())).decode()
    text = f"one {blob} two {blob} three {deep} end"
    assert len([f for f in secrets.scan(text) if f[0] == "aws_access_key"]) == 3
    assert secrets.redact(text) == f"one {secrets.MASK} two {secrets.MASK} three {secrets.MASK} end"
    both = base64.b64encode(f"{KEY} and AKIA{KEY[:3:-1]}".encode()).decode()
    assert len({f[5] for f in secrets.scan(f"x {both} y") if f[0] == "aws_access_key"}) == 2


@pytest.mark.parametrize("before, after", [("cfg=", ""), ("https://host/x?data=", "&n=1"), ("A_LONG_NAME_OF_MANY_WORDS=", " x"), ("https://host/p/", ""), ("https://host/path/", "/more/of/it"), ("name-", ""), ("a_b-", "-tail")])
@pytest.mark.parametrize("pack", [str.encode, lambda s: gzip.compress(s.encode())])
@pytest.mark.parametrize("code", [base64.b64encode, base64.urlsafe_b64encode])
def test_secrets_in_paths_and_names(before, after, pack, code):
    for more in ("", "?>~ü?>~~ " * 3):
        run = code(pack(f"{KEY} {more}is the key {more}")).decode()
        redacted = secrets.redact(f"see {before}{run}{after} end")
        assert run[:24] not in redacted and redacted.startswith(f"see {before}{secrets.MASK}") and redacted.endswith(" end"), (run, redacted)


def _tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        entry = tarfile.TarInfo("app/.env")
        entry.size = len(KEY)
        tar.addfile(entry, io.BytesIO(KEY.encode()))
    return out.getvalue()


@pytest.mark.parametrize("data", [_tar(), KEY.encode("utf-16"), f"the key is {KEY}".encode("utf-16-be"), b"\xff\xfe\xfd " + KEY.encode(), b"\0" * 5000 + KEY.encode()] + [f(b"first ") + f(KEY.encode()) for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress)])
def test_secrets_in_whole_layers(data):
    run = base64.b64encode(data).decode()
    assert {f[0] for f in secrets.scan(f"before {run} after")} >= {"aws_access_key"}
    assert secrets.redact(f"before {run} after") == f"before {secrets.MASK} after"


@pytest.mark.parametrize("press", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
@pytest.mark.parametrize("escape", [quote, lambda b: "".join(f"%{c:02x}" for c in b), lambda b: "".join(f"\\x{c:02x}" for c in b), lambda b: "".join(f"\\u{c:04x}" for c in b), lambda b: "".join(f"&#{c};" for c in b)])
def test_secrets_compressed_in_escapes(press, escape):
    run = escape(press(f"the key is {KEY}".encode()))
    assert "aws_access_key" in {f[0] for f in secrets.scan(f"before {run} after")}
    assert secrets.redact(f"before {run} after") in (f"before {secrets.MASK} after", f"before {run} after".replace(KEY, secrets.MASK))


ENCODERS = {
    "url": (lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: bytes.fromhex(t.replace("%", "")).decode()),
    "unicode": (lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(chr(int(x, 16)) for x in t.split("\\u")[1:])),
    "entity": (lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: "".join(chr(int(x)) for x in t.replace("&#", "").split(";")[:-1])),
    "base64": (lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64decode(t).decode()),
    "gzip": (lambda t: base64.b64encode(gzip.compress(t.encode())).decode(), lambda t: gzip.decompress(base64.b64decode(t)).decode()),
    "zlib": (lambda t: base64.urlsafe_b64encode(zlib.compress(t.encode())).decode(), lambda t: zlib.decompress(base64.urlsafe_b64decode(t)).decode()),
}


def _nestings(run, depth):
    """Brute force: every text that depth decoders or fewer, in any order, make of run."""
    yield run
    for _, decode in ENCODERS.values() if depth else ():
        try:
            yield from _nestings(decode(run), depth - 1)
        except Exception:  # noqa: BLE001, S110
            pass


def test_secrets_in_all_nestings():
    """Every nesting of the encoders to depth 3, twice in one text: both are told, and nothing that decodes to the key stays."""
    for depth in (1, 2, 3):
        for names in itertools.product(ENCODERS, repeat=depth):
            run = f"the key is {KEY} and no other"
            for name in names:
                run = ENCODERS[name][0](run)
            assert any(KEY in x for x in _nestings(run, depth))
            text = f"first {run} then {run} end"
            found = [f for f in secrets.scan(text) if f[0] == "aws_access_key"]
            assert len(found) >= 2 and {f[1] < len(text) // 2 for f in found} == {True, False}, names
            left = secrets.redact(text).split()
            assert left[0] == "first" and left[-1] == "end" and not any(KEY in x for part in left for x in _nestings(part, depth)), names


@pytest.mark.parametrize("value", ["a1" * 200, "a1" * 5000])
def test_secrets_of_any_length(value):
    assert secrets.redact(f"token={value} end") == f"{secrets.MASK} end"
    assert secrets.redact(f'secret: "{value}!" end') == f"{secrets.MASK} end"
    assert secrets.redact(f"see https://{value}:{value}@host/x") == f"see https{secrets.MASK}host/x"
    assert secrets.redact(f"{'long_' * 2000}api_key   \t  =   {value} end").endswith(f"{secrets.MASK} end")
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{value}\n-----END RSA PRIVATE KEY-----"
    assert secrets.redact(f"a {pem} b") == f"a {secrets.MASK} b"


def test_secrets_in_streams(monkeypatch):
    """What decompresses to more than a piece is scanned piece by piece, wherever the key stands."""
    monkeypatch.setattr(secrets, "PIECE", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 256)
    for press in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for fill in ("words of no interest ", "x" * 21):
            for at in (0, 4080, 4096, 9000, 40_000):
                data = (fill * 2500)[:at] + (" " if fill[0] == "w" else "=") + KEY + "=" + (fill * 2500)[:3000]
                for body in (press(data.encode()), press(press(data.encode()))):
                    text = f"a {base64.b64encode(body).decode()} b"
                    assert "aws_access_key" in {f[0] for f in secrets.scan(text)}, (press, fill, at)
                    assert secrets.redact(text) == f"a {secrets.MASK} b"


def test_secret_rules_take_time_in_proportion():
    assert [f[:3] for f in secrets.scan("x eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSM-eKKF2QT4 y")] == [("json_web_token", 2, 55)]
    for text in ("eyJ-" * 50_000, "eyJ-" * 50_000 + ".eyJ", "-----BEGIN PRIVATE KEY-----\n" * 20_000, "a_" * 200_000, "key" + " " * 300_000, "x://" * 100_000, "http://" + "a" * 300_000, "token=" * 80_000, "a+" * 200_000 + "://"):
        began = time.process_time()
        secrets.scan(text)
        assert time.process_time() - began < 8, text[:30]


def test_closest_spans():
    rng = np.random.default_rng(1)
    for _ in range(200):
        spans = {(int(a), int(a + n)): (1, "") for a, n in zip(rng.integers(0, 20, 12), rng.integers(1, 9, 12))}
        want = {x for x in spans if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in spans)}
        assert set(secrets.closest(spans)) == want


def test_lines(spark):
    rows = [(i, f"own {i}\n shared line \nend", "en", f"s{i}") for i in range(9)] + [(9, "shared line", "en", None), (10, None, "en", "s1")]
    found = {r["doc_id"]: r for r in line_dedup.drop_widespread_lines(docs(spark, rows)).collect()}
    assert found[0]["text"] == "own 0" and found[0]["n_removed"] == 2 and found[0]["n_lines"] == 3
    assert found[9]["text"] == "" and found[10]["text"] is None
    few = line_dedup.drop_widespread_lines(docs(spark, rows[:7])).collect()
    assert all(r["n_removed"] == 0 for r in few)


def test_html():
    page = "<html><head><title>no</title></head><body><p>One<p>Two<ul><li>a<li>b</ul><table><tr><td>x<td>yy<tr><td>long<td>z</table><div hidden>h</div><span style='display: none'>n</span><script>s()</script>end"
    assert html_text.render(page) == "One\n\nTwo\n\n- a\n- b\n\nx     yy\nlong  z\n\nend"
    assert html_text.render("") == "" and html_text.render("<div>" * 3000 + "deep") == "deep"


@pytest.mark.parametrize("page, want", [("<table><form><tr><td>text</td></tr></form></table>", "text"), ("<table><tr><form><td>text</td></form></tr></table>", "text"), ("<table><center><tr><td>text</table>end", "text\n\nend"), ("<table><div>text</div><tr><td>cell</table>", "text\n\ncell"), ("<table><tr><td>a<table><tr><td>b</table></table>", "a\n\nb"), ("<svg><defs/><title>no</title><path d='x'/><text>one</text></svg>", "one"), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1")])
def test_html_text_out_of_place(page, want):
    assert html_text.render(page) == want


class _Visible(HTMLParser):
    """Brute force: the words of all text nodes outside hidden elements, however the page is laid out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "head", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "head", "noscript", "template")

    def handle_data(self, data):
        if self.hidden <= 0:
            self.words += data.split()


def test_html_loses_no_text():
    """Any nesting of blocks, lists, tables and inline tags, closed or not, keeps the words of every visible text node."""
    rng = np.random.default_rng(4)
    tags = "div p ul li table tr td th b i span blockquote pre form center h1 dl dt dd a section caption tbody em".split()
    for case in range(300):
        page, n = [], 0
        for _ in range(int(rng.integers(3, 40))):
            tag = str(rng.choice(tags))
            kind = rng.integers(4)
            if kind == 0:
                page.append(f"<{tag}>")
            elif kind == 1:
                page.append(f"</{tag}>")
            elif kind == 2:
                page.append(f" t{case}x{n} ")
                n += 1
            else:
                page.append(f"<{tag} title='a > b' class=\"c\"> u{case}x{n} </{tag}><!-- no -->")
                n += 1
        parser = _Visible()
        parser.feed("".join(page))
        parser.close()
        assert sorted(w for w in html_text.render("".join(page)).split() if w[0] in "tu" and "x" in w) == sorted(parser.words), "".join(page)


@pytest.mark.parametrize("page, want", [("<table><form><tr><td>x</td></tr></form></table>", "x"), ("<table><div>hello</div><tr><td>x</table>", "hello\n\nx"), ("<table><center>hi</center><tr><td>x</table>", "hi\n\nx"), ("<table><tr><b>bold</b><td>x</table>", "bold\n\nx"), ("<svg><text>label</text></svg>", "label"), ("<a title=\"1 > 0\">x</a>", "x"), ("a < b <3 > c", "a < b <3 > c"), ("<p title='it>x", "x"), ("<!-->x<!--->y<!-- z --!>w", "xyw")])
def test_html_shows(page, want):
    assert html_text.render(page) == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a>" * 300_000, "<a \"<\"<" * 100_000 + ">", "<p><b>" * 150_000, "<a b='>\" " * 100_000, "<" * 1_000_000])
def test_html_takes_time_in_proportion(page):
    """Quadratic time would be minutes for a page of 1 MB."""
    began = time.process_time()
    html_text.render(page)
    assert time.process_time() - began < 10


def test_licences(spark):
    name = "MIT/full"
    text = license_scan.TEMPLATES[name]
    changed = text.replace("free of charge", "without any charge")
    found = license_scan.license_scan(docs(spark, [(1, f"{ALPHA} {text} {ALPHA}", "en", "s"), (2, f"{ALPHA} {changed}", "en", "s"), (3, ALPHA, "en", "s"), (1, None, "en", "s")])).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(1, name), (2, name)]
    one = next(r for r in found if r["doc_id"] == 1)
    n = len(license_scan.words_of(ALPHA))
    assert one["similarity"] == 1 and one["first_word"] == n and one["end_word"] == n + len(license_scan.words_of(text))


def test_licences_against_all_alignments(spark):
    """Brute force: the similarity of every window of every text with every template by the longest common subsequence."""
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = {f"T{i}": " ".join(rng.choice(vocabulary, n)) for i, n in enumerate((6, 9, 14))}
    rows, want = [], {}
    for i in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 15))))
        if i % 3:
            t = templates[f"T{i % 4 % 3}"].split()
            if i % 2 and len(t) > 6:  # of the shortest, too few windows would be left to vote
                t[int(rng.integers(len(t)))] = "other"
            words += [*t, *rng.choice(vocabulary, int(rng.integers(0, 10)))]
        rows.append((i, " ".join(words), "en", "s"))
        for name, text in templates.items():
            t, best = text.split(), 0.0
            for a in range(len(words)):
                row = [0] * (len(t) + 1)  # lengths of the common subsequences of the window so far
                for b in range(a, min(len(words), a + 2 * len(t))):
                    last = row
                    row = [0]
                    for j in range(len(t)):
                        row.append(last[j] + 1 if words[b] == t[j] else max(last[j + 1], row[j]))
                    best = max(best, 2 * row[-1] / (len(t) + b + 1 - a))
            if best >= 0.8:
                want[i, name] = round(best, 6)
    found = {(r["doc_id"], r["license"]): r["similarity"] for r in license_scan.license_scan(docs(spark, rows), templates=templates).collect()}
    assert len(want) > 20 and found == want


def test_licences_in_a_row(spark):
    short = {n: t for n, t in license_scan.TEMPLATES.items() if 3 <= len(license_scan.words_of(t)) <= 9}
    assert short
    rows = [(i, between.join([t] * 4), "en", "s") for i, (t, between) in enumerate((t, b) for t in short.values() for b in ("\n", "\nsee also\n", "\none two three\n"))]
    found = license_scan.license_scan(docs(spark, rows)).collect()
    for i, name in enumerate(n for n in short for _ in range(3)):
        assert [r["license"] for r in found if r["doc_id"] == i] == [name] * 4
    words = license_scan.words_of("\n".join([next(iter(short.values()))] * 3))
    run = [{"license": next(iter(short)), "low": 0, "high": len(words), "votes": 3}]
    assert len(license_scan.verify(words, run, {n: license_scan.words_of(t) for n, t in short.items()}, 0.8)) == 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, matches_sql):
    matches_sql(QUERIES[name], ORACLES[name])


def test_pipeline_on_odd_and_empty_tables(spark, odd, none):
    """Every stage takes what the one before it kept, be it nothing, with columns of any name and rows that repeat."""
    for table in (none, odd.limit(0).unionByName(odd)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.written(stage(spark, kept, ""))
            assert kept.columns == table.columns, name
        windows = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
        texts = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in kept.collect()]
        assert rebuilt(windows) == sorted(texts) and all(t.strip() for *_, t in texts)
    assert len(texts) >= 2 and len({t for *_, t in texts}) == len(texts)


def test_pipeline_stages(spark):
    at = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{at}/documents.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, at))
        assert kept.columns == table.columns, name
    texts = [r["text"] for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts)) and 0.5 * table.count() < len(texts) <= table.select("text").distinct().count()
    assert all(not secrets.scan(t) for t in texts)
    windows = corpus_pipeline.run(spark, at).collect()
    assert sum(r["n_words"] for r in windows) == sum(len(t.encode().split()) for t in texts)
    assert [t for *_, t in rebuilt(windows)] == [t for _, t in sorted((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect())]
