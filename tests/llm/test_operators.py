"""The dealt operators against brute force, round trips and held-out labels, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from fluxframe.llm import encode, lm, nearjoin, ordermin, packing, pii, quality, queries, spm, tokenio, topk, urls
from fluxframe.session import shared_folder

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toArrow().to_pylist()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in run(spark, name)]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_url_verdicts_on_awkward_rows(spark):
    rules = spark.createDataFrame(
        [("a.com", "/x", "block"), ("com", "", "allow"), (None, "/", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/x/y", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame(
        [(1, "http://B.A.com/x/yz?q"), (1, "http://B.A.com/x/yz?q"), (2, "https://a.com/xx#f"), (3, None), (4, "a.com/x"), (5, ""), (6, "http://" + "q." * 3000 + "com"),
         (None, "ftp://other.net"), (7, "http://xa.com/x")], "page_id long, url string").selectExpr("*", "url AS host", "url AS rule", "1 AS row", "2 AS prefix")
    got = sorted(((r.page_id, r.host[-8:], r.path, r.rule, r.verdict) for r in urls.url_verdicts(pages, rules).collect()), key=repr)
    assert got == sorted([
        (1, "b.a.com", "/x/yz", "b.a.com/x/y", "allow"), (1, "b.a.com", "/x/yz", "b.a.com/x/y", "allow"), (2, "a.com", "/xx", "a.com/x", "block"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, ".q.q.com", "", "com", "allow"), (None, "ther.net", "", None, "allow"), (7, "xa.com", "/x", "com", "allow")], key=repr)
    assert urls.url_verdicts(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in urls.url_verdicts(pages, rules.filter("false"), default="block").collect()} == {"block"}


def test_quality_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").toArrow().to_pylist()}
    labels = duckdb.connect().execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[d]["predicted"], q) for d, q in labels if got[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert np.mean([p == q for p, q in held]) > 0.95


def test_non_negative_risk_finds_the_prior():
    rng = np.random.default_rng(1)
    positive, mixed = rng.normal(2, 1, (600, 3)), np.vstack([rng.normal(2, 1, (900, 3)), rng.normal(-2, 1, (600, 3))])
    model = quality.fit_pu(positive, mixed)
    assert abs(model.prior - 0.6) < 0.1
    assert (model.score(mixed)[:900] >= 0.5).mean() > 0.95 and (model.score(mixed)[900:] < 0.5).mean() > 0.95
    assert (quality.fit_pu(positive[:3], mixed).score(mixed) == 0.5).all()


def test_few_trusted_documents_of_many(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('$$ ### buy ', id) ELSE concat('A plain sentence of words, number ', id, '.') END AS text")
    trusted = docs.filter("doc_id % 60 = 1").select("doc_id")
    model = quality.fit_quality(docs, trusted, sample=300)
    assert model.weights is not None
    assert quality.score_quality(docs, model).filter("(predicted = 1) = (doc_id % 3 > 0)").count() > 0.9 * 9000
    with pytest.raises(ValueError, match="trusted"):
        quality.fit_quality(docs, trusted.limit(3), sample=300)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(sets):
    """(id, set) list -> smallest id reached, by comparing all pairs."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)].append(d)
    return [min(least[root(i)], default=None) for i in range(len(sets))]


def test_shingle_classes_by_brute_force(spark, texts):
    rng = random.Random(3)
    docs = [(d, t) for d, t in texts.items()]
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    for k in range(120):  # a family with more and more changes
        w = list(base)
        for _ in range(rng.randrange(0, 40)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        docs.append((1000 + k, " ".join(w)))
    for n in range(1, 30):  # short ones around the threshold
        docs += [(2000 + n, " ".join(f"s{n}_{i}" for i in range(n))), (2100 + n, " ".join(f"s{n}_{i}" for i in range(n + 1)))]
    got = {r["doc_id"]: r for r in nearjoin.shingle_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).toArrow().to_pylist()}
    sets = [(d, shingles(t)) for d, t in docs]
    for (d, s), want in zip(sets, classes(sets)):
        assert got[d]["n_shingles"] == len(s) and got[d]["component_id"] == (want if s else d)


@pytest.mark.parametrize("few", [0, nearjoin.FEW, 10**9])
def test_far_sets_of_a_group(spark, few):
    """Families that differ from a common core in the same places, so that links lie between sets far from any leader."""
    rng = random.Random(5)
    core, docs = [f"c{i}" for i in range(200)], []
    for family in range(25):
        places = rng.sample(range(200), 12)
        for _ in range(rng.randrange(1, 5)):
            w = list(core)
            for p in rng.sample(places, rng.randrange(6, 13)):
                w[p] = f"f{family}_{p}"
            docs.append((len(docs), " ".join(w[: rng.randrange(170, 201)])))
    docs += [(len(docs), " ".join(core)), (len(docs) + 1, " ".join(core[:-3]))]
    got = {r.doc_id: r.component_id for r in nearjoin.shingle_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), few=few).collect()}
    want = classes([(d, shingles(t)) for d, t in docs])
    assert [got[d] for d, _ in docs] == want and 5 < len(set(want)) < len(docs)


@pytest.mark.parametrize("few", [0, nearjoin.FEW])
@pytest.mark.parametrize("other", [None, 5])
def test_carrier_behind_a_copy_under_another_id(spark, few, other):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words, "end"])
    docs = spark.createDataFrame([(other, a), (other, b), (3, a)], "doc_id long, text string").coalesce(1)
    assert [r.component_id for r in nearjoin.shingle_classes(docs, few=few).collect()] == [3, 3, 3]


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
        b = np.unique(np.concatenate([a[40:], rng.integers(0, 2**63, 30).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert np.unpackbits((nearjoin.bit_sketch(a) ^ nearjoin.bit_sketch(b)).view(np.uint8)).sum() <= apart
        band = nearjoin.band_of(len(a))
        assert len(np.setdiff1d(nearjoin.segment_keys(a, band), nearjoin.segment_keys(b, band))) <= apart


def test_segments_are_exchanged_in_turns(spark, texts):
    docs = spark.createDataFrame([*texts.items(), (-1, None), (-2, texts[min(texts)])], "doc_id long, text string").repartition(2, "doc_id")
    none, n = np.zeros(0, dtype=np.uint64), nearjoin.PASSES
    whole, *parts = ([repr(r) for r in nearjoin._rows(docs, none, *turn).collect()] for turn in [(), *((t, n) for t in range(n))])
    assert n > 1 and sorted(itertools.chain.from_iterable(parts)) == sorted(whole)
    segments = [sum("kind=1," in r for r in p) for p in parts]
    assert max(segments) < 0.6 * sum(segments) and [len(p) - k for p, k in zip(parts, segments)] == [len(texts) + 2, *[0] * (n - 1)]


def test_segments_travel_packed(spark, texts):
    """Twelve bytes a segment whatever the number of partitions, and those of several sets come out with exact counts."""
    first = texts[min(texts)]
    rows = [*texts.items(), (-1, None), (-2, first), (-3, first + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    sets = {nearjoin._identity(s): s for s in nearjoin.shingle_sets([t for _, t in rows]) if len(s)}
    for places in (4, 64):
        want = collections.defaultdict(set)
        for node, s in sets.items():
            for band in nearjoin._bands(len(s)):
                for name in nearjoin.segment_names(s, band, places).tolist():
                    want[name].add(node)
        often = max(want, key=lambda name: len(want[name]))
        single = next(name for name in want if len(want[name]) == 1)
        for heavy in ([], sorted([often, single])):
            sent = nearjoin._rows(docs, np.array(heavy, dtype=np.uint64), places=places)
            blocks = sent.filter("kind = 1").selectExpr("octet_length(names) AS names", "octet_length(nodes) AS nodes").collect()
            assert len(blocks) <= 2 * places and all(2 * b.names == b.nodes for b in blocks)
            assert sum(b.names for b in blocks) // 4 >= sum(len(v) for k, v in want.items() if k not in heavy)
            got = {(r.key, r.node): r.sets for r in nearjoin._met(sent, 3).filter("kind = 1").collect()}
            counts = {k: nearjoin.MANY if k in heavy else len(v) for k, v in want.items()}
            assert got == {(k, n): counts[k] for k, v in want.items() for n in v if counts[k] > 1} and len(got) > 2


def test_sets_of_all_sizes_have_segments_enough():
    """Beyond very short ones, no set needs the key that all sets of its band share."""
    rng = np.random.default_rng(1)
    for n in [*range(64, 700, 7), *range(700, 11000, 90)]:
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for band in nearjoin._bands(len(s)):
            assert len(nearjoin.segment_keys(s, band)) > nearjoin._most_apart(len(s), band), (n, band)


def test_long_sets_beside_band_borders(spark):
    """Sets of 600-1,300 and 2,300-2,560 shingles, their partners just inside and outside of the similarity."""
    rng, docs = random.Random(9), []
    for n in [600, 640, 700, 800, 1000, 1023, 1025, 1170, 1270, 1300, 2300, 2400, 2500, 2560]:
        base = [f"b{n}_{i}" for i in range(n + 4)]
        for size in (1.0, 0.79, 0.801, 0.85, 0.95):  # parts in front
            docs.append((len(docs), " ".join(base[: int(n * size) + 4])))
        for edits in (n // 45, n // 46, n // 50, n // 60):
            w = list(base)
            for p in rng.sample(range(0, n, 6), edits):
                w[p] = f"e{p}"
            docs.append((len(docs), " ".join(w)))
    rng.shuffle(docs)
    want = classes([(d, shingles(t)) for d, t in docs])
    for few in (0, nearjoin.FEW):
        got = {r.doc_id: r.component_id for r in nearjoin.shingle_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), few=few).collect()}
        assert [got[d] for d, _ in docs] == want


def test_one_per_class_keeps_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", "x"), (2, "one two three four five six", "y"), (3, "another text of some six words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr(
        "doc_id", "text", "key AS __row", "key AS __drop", "key AS row", "key AS number", "key AS gone", "key AS id", "key AS component_id")
    for table in (docs, docs.union(docs.filter("doc_id = 3"))):
        got = nearjoin.one_per_class(table)
        assert got.columns == docs.columns and sorted((r["doc_id"], r["__row"], r["gone"]) for r in got.collect()) == [(1, "x", "x"), (3, "z", "z")]


def test_keep_good_judges_each_row(spark, awkward, empty):
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet")))
    good = [r.predicted for r in quality.score_quality(awkward, model).collect()]
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(good) and quality.keep_good(empty, model).count() == 0


def test_one_per_class(spark, awkward, empty):
    rows = nearjoin.one_per_class(awkward).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, range(1, 11)))
    assert nearjoin.one_per_class(awkward).columns == awkward.columns
    assert nearjoin.one_per_class(empty).count() == 0 and nearjoin.shingle_classes(empty).count() == 0


def test_one_per_class_goes_by_row(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), "quite another text with no word in common"
    rows = [(5, b), (5, a), (3, a), (None, a + " end"), (None, None), (None, None), (None, " "), (None, "a third text of six words"), (6, "")]
    got = nearjoin.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(3, a), (5, b), (None, None), (None, None), (None, " "), (None, "a third text of six words"), (6, "")]))


def test_lm_scores_by_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op4_lm_scores")}
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(w for d in train for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in c for x in w), n, d not in train)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    held = [d for d in texts if got[d]["held_out"]]
    assert sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held)


def test_hashes_travel_whole():
    """All 64 bits of ascending hashes come back, for one hash, for steps of any width and for the ends of the range."""
    rng = np.random.default_rng(5)
    for g in ([7], [0, 2**64 - 1], [3, 4, 5], rng.integers(0, 2**64, 5000, dtype=np.uint64, endpoint=False), 2**63 + rng.integers(0, 2**46, 900, dtype=np.uint64)):
        g = np.unique(np.array(g, dtype=np.uint64))
        assert lm._hashes(lm._ascending(g)).tolist() == g.tolist()


def test_url_prefixes_are_confirmed(spark):
    """With prefixes of one digit, or none at all, nearly all rules share theirs; verdicts are those of full digests."""
    rules = spark.createDataFrame([(f"h{i}.com", f"/{j}", "block") for i in range(40) for j in range(3)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/{i % 5}/x") for i in range(60)], "page_id long, url string")
    want = {(i, f"h{i}.com/{i % 5}" if i < 40 and i % 5 < 3 else None) for i in range(60)}
    for digits in (8, 1, 0):
        assert {(r.page_id, r.rule) for r in urls.url_verdicts(pages, rules, prefix_digits=digits).collect()} == want


def test_mixture_weight():
    w = lm.em_weight(np.array([1.0, 1.0]), np.array([2.0, 0.1]), steps=5000)
    grid = np.linspace(0, 0.999, 1000)
    best = grid[np.argmax(np.log(1 + grid) + np.log(1 - 0.9 * grid))]
    assert w == pytest.approx(best, abs=2e-3)


def test_lm_probabilities_add_up(spark):
    """Over all tokens that may follow, the model's probability is 1 (one of them stands for the unknown)."""
    model = lm.Interpolation(10, 3, 0.7, np.zeros(lm.BUCKETS))
    assert sum(model.lower(np.array([5, 3, 2]), 10)) + model.lower(np.array([0]), 10)[0] == pytest.approx(1.0)


def whole_ids(name, texts, end):
    t = Tokenizer.from_file(path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def pieces_are_whole(pieces, ids):
    """``ids``: list of (doc_id, tokens). Pieces of equal ids may come from any row with that id, so they are compared as a bag of tokens."""
    seen, sequences = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        seen.update((p["doc_id"], p["start"] + i, t) for i, t in enumerate(np.frombuffer(p["ids"], "<u4").tolist()))
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["sequence_tokens"]))
    assert seen == collections.Counter((d, i, t) for d, x in ids for i, t in enumerate(x.tolist()))
    for v in sequences.values():
        at = 0
        for offset, length, size in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at == v[0][2] <= 2048 and at & (at - 1) == 0


@pytest.mark.parametrize("table", ["given", "awkward"])
def test_packing_holds_every_id_once(spark, texts, awkward, table):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string") if table == "given" else awkward
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    pieces = packing.pack_documents(df, path("byte_bpe_50k.json")).toArrow().to_pylist()
    pieces_are_whole(pieces, [(d, x) for (d, _), x in zip(rows, whole_ids("byte_bpe_50k.json", [t for _, t in rows], 1))])
    assert packing.pack_documents(df.filter("false"), path("byte_bpe_50k.json")).count() == 0


def test_step_groups_are_balanced(texts):
    p = packing.Packer()
    tokens = collections.defaultdict(set)
    for *_, number, offset, size, step in p.pack([random.Random(i).randrange(1, 3000) for i in range(800)]):
        tokens[step].add((number, size))
    for v in tokens.values():
        assert len({s for _, s in v}) == 1 and sum(s for _, s in v) <= packing.STEP_TOKENS


ODD = ["", " ", "  a b", "a \n b", "x\n\ny\n", "tab\there x", "é ñ b ́c", "日本 語", "a <|endoftext|> b", "word's it's 'll", "nbsp x", "a\r\nb", "ΑΣ ΑΣ.", "§ a § b", "\0 n\0ul a", "x " * 50]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_encoding_is_the_tokenizers_own(name, texts):
    sample = ODD + list(texts.values())[:60]
    ids, at = encode.PieceEncoder(path(name)).encode(sample)
    for i, want in enumerate(whole_ids(name, sample, 1)):
        assert ids[at[i] : at[i + 1]].tolist() == want[:-1].tolist()


def test_an_encoder_that_forgets_gives_the_same_ids(texts):
    sample = ODD + list(texts.values())[:60]
    small, large = (encode.PieceEncoder(path("byte_bpe_50k.json"), remember=n) for n in (50, encode.WORDS))
    for i in range(0, len(sample), 7):
        got, want = small.encode_closed(sample[i : i + 7], 1), large.encode_closed(sample[i : i + 7], 1)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert len(small.words) < len(large.words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_an_encoder_keeps_the_pieces_that_recur(name):
    encoder, learned = encode.PieceEncoder(path(name), remember=80), []
    learn = encoder._learn_pieces
    encoder._learn_pieces = lambda keys: (learned.extend(keys), learn(keys))[1]
    sample = [f"The common words, the common Größe. {' '.join('abcdefghij'[j] * (i + 1) for j in range(10))}\nthe common" for i in range(40)]
    for text, want in zip(sample, whole_ids(name, sample, 1)):
        assert encoder.encode_closed([text], 1)[0].tolist() == want.tolist()
    assert learned.count("common") == 1 and len(encoder.pieces) < 200 < len(set(learned))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_all_latin_letters(name):
    letters = [chr(c) for c in range(0xC0, 0x250)]
    sample = [" ".join(f"x{c}y {c}{c}, a{c}\n{c}b {c}" for c in letters[i : i + 40]) for i in range(0, len(letters), 40)]
    ids, at = encode.PieceEncoder(path(name), check=0).encode(sample)
    for i, want in enumerate(whole_ids(name, sample, 1)):
        assert ids[at[i] : at[i + 1]].tolist() == want[:-1].tolist()


@pytest.mark.parametrize("table", ["given", "awkward"])
def test_token_files_round_trip(spark, texts, awkward, table):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3) if table == "given" else awkward
    rows = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()])
    files = tokenio.write_token_files(df, path("word_bpe_49k.json"), file_bytes=20_000)
    got = sorted(tokenio.read_token_files(files, shared_folder(spark)).collect(), key=lambda r: r.start)
    want = whole_ids("word_bpe_49k.json", [t for *_, t in rows], 1)
    at = 0
    for r, (known, d, _), x in zip(got, rows, want, strict=True):
        assert (r.doc_id, r.start) == (d if known else None, at)
        at += r.n_tokens
    assert sorted(bytes(r.ids) for r in got) == sorted(x.tobytes() for x in want)
    assert tokenio.read_token_files(tokenio.write_token_files(df.filter("false"), path("word_bpe_49k.json")), shared_folder(spark)).count() == 0


def test_token_file_reads_only_what_is_asked_and_finds_damage(tmp_path):
    from pyarrow import fs
    import zstandard

    place, store = str(tmp_path / "f"), fs.LocalFileSystem()
    docs = [np.arange(n, dtype=np.uint32) * 7 % 60000 for n in (3, 0, 1000, 50, 5000)]
    w = tokenio.TokenFileWriter(store.open_output_stream(place), 2, frame_ids=256)
    for i, d in enumerate(docs):
        w.add(i or None, d)
    w.close()
    with store.open_input_file(place) as f:
        file, read = tokenio.TokenFile(f), []
        inner = file.frame
        file.frame = lambda k: (read.append(k), inner(k))[1]
        assert file.document(3).tolist() == docs[3].tolist() and read == [3, 4]
        assert [file.document(i).tolist() for i in range(5)] == [d.tolist() for d in docs] and file.doc_ids == [None, 1, 2, 3, 4]
    raw = bytearray(open(place, "rb").read())
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(raw))
    assert plain.startswith(np.concatenate(docs).astype("<u2").tobytes())  # any zstandard reader can
    raw[30] ^= 255
    open(place, "wb").write(raw)
    with store.open_input_file(place) as f, pytest.raises(Exception):
        tokenio.TokenFile(f).document(0)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_by_brute_force(spark, texts):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "9", "1.2.3.4", "@", ".", "-", " ", "+", "4111 1111 1111 1111", "é", "0", "_", "(", ")", "x@y.z", "+1 (212) 555-0199", "4111-1111-1111-1111 ", "\U0001F600"]) for _ in range(60)) for _ in range(400)]
    made += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4" * 3000, "a" * 20000, "1 " * 8000, "a@b" + ".c" * 5000, "+1" + " (" * 3000, None, ""]
    docs = list(enumerate(list(texts.values()) + made))
    for r in pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS found", "'y' AS spans")).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == base_spans(docs[r.doc_id][1] or ""), docs[r.doc_id][1]


def test_votes_decide_what_is_added():
    votes = np.array([[2, 2, 2], [0, 0, 0], [1, 2, 2], [1, 0, 0]])
    p = pii.estimate(votes, np.array([50.0, 50.0, 10.0, 10.0]))
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] > 0.5 > p[3]


def test_redaction(spark, awkward, empty):
    docs = spark.createDataFrame([(1, "é +1 (212) 555-0199, a.b@c.org!", 31, "s"), (2, "clean", 5, None), (3, None, None, "t"), (4, "1.2.3.4", 7, "u")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["é <PHONE>, <EMAIL>!", "clean", None, "<IP>"] and [got[i].n_chars for i in (1, 2, 3, 4)] == [19, 5, None, 4]
    assert pii.redacted(docs).columns == docs.columns and got[1].spans == "s"
    assert pii.redacted(awkward).count() == awkward.count() and pii.redacted(empty).count() == 0 and pii.pii_spans(empty).count() == 0


def test_order_minhash_neighbours(spark, texts, awkward, empty):
    got = {r["doc_id"]: r for r in run(spark, "op8_order_minhash")}
    order = sorted(texts, reverse=True)
    prints = {d: ordermin.fingerprints([texts[d]])[0] for d in order}
    for i, d in enumerate(order):
        t, following, r = texts[d], order[(i + 1) % len(order)], got[d]
        n = len(t) // 3
        changed = t[: len(t) - n] + texts[following][:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == ordermin.as_text(prints[d]) and r["near_next"] == ordermin.likeness(prints[d], prints[following])
        assert r["near_edited"] == ordermin.likeness(prints[d], ordermin.fingerprints([changed])[0])
    assert np.median([r["near_edited"] for r in got.values()]) > 0.15 > 0.05 > np.median([r["near_next"] for r in got.values()])
    assert ordermin.compare_with_next(awkward).count() == awkward.count() and ordermin.compare_with_next(empty).count() == 0
    (one,) = ordermin.compare_with_next(awkward.filter("doc_id = 7")).collect()
    assert one.near_next == 1.0


def test_order_counts_in_a_fingerprint():
    words = [f"w{i}" for i in range(200)]
    shuffled = words[100:] + words[:100]
    a, b, c = ordermin.fingerprints([" ".join(words), " ".join(words[:195]), " ".join(shuffled)])
    assert ordermin.likeness(a, b) > 0.85 and ordermin.likeness(a, c) < 0.75
    assert ordermin.occurrence_kmers(np.array([1, 1, 1, 1], dtype=np.uint64)).size == len(set(ordermin.occurrence_kmers(np.array([1, 1, 1, 1], dtype=np.uint64)).tolist()))


def test_case_counts_in_a_fingerprint():
    a, b, c = ordermin.fingerprints(["Some Words as They were written", "some words as they were written", "Some  Words as\nThey were written"])
    assert ordermin.likeness(a, b) < 0.5 and ordermin.likeness(a, c) == 1.0


def test_ids_are_the_rebuilt_tokenizers(texts):
    codec = spm.Codec(path("piece_bpe_32k.model"))
    wrong = type("Wrong", (), {"encode": staticmethod(lambda ts, num_threads=1: [[0]] * len(ts))})
    sample = [t for t in list(texts.values())[:5] if t]
    right = [ids.tolist() for ids, *_ in codec.encode(sample)]
    codec.known.clear()
    codec.own = wrong
    assert [(ids.tolist(), same, back) for ids, same, back in codec.encode(sample)] == [(r, False, True) for r in right]


def test_sentencepiece_parity_and_round_trip(spark, texts, awkward, empty):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    codec = spm.Codec(path("piece_bpe_32k.model"))
    sample = [t for t in ODD if "\0" not in t] + list(texts.values())[:80] + ["▁ a", "a ▁b", "emoji \U0001F600 x"]
    for t, (ids, _, back) in zip(sample, codec.encode(sample)):
        assert ids.tolist() == own.encode(t) and back == (codec.decode([ids]) == [t])
    got = run(spark, "op9_sentencepiece")
    assert len(got) == len(texts) and all(r["parity"] and r["round_trip"] for r in got)
    assert spm.encode_documents(awkward, path("piece_bpe_32k.model")).count() == awkward.count() and spm.encode_documents(empty, path("piece_bpe_32k.model")).count() == 0


def test_unigram_models_are_rebuilt():
    """A small unigram model, written by hand in the file format."""
    import struct

    def message(*parts):
        return b"".join(bytes([n << 3 | 2, len(v)]) + v if isinstance(v, bytes) else bytes([n << 3 | 5]) + struct.pack("<f", v) if isinstance(v, float) else bytes([n << 3, v]) for n, v in parts)

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -1.5, 1), ("▁", -3.0, 1), ("a", -3.0, 1)]
    raw = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces) + message((2, message((3, 1)))) + message((3, message((3, 1), (4, 1), (5, 1))))
    built = spm.SentencePieceModel.parse(raw)
    assert built.kind == spm.UNIGRAM and [p for p, *_ in built.pieces][3] == "▁ab"
    assert built.tokenizer().encode("ab  a b", add_special_tokens=False).tokens == ["▁ab", "▁a", "▁", "b"]


def test_top_k_on_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [-1.0]), (None, [9.0, 9.0]), (50, [0.5, 0.5, 3.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS part", "3 AS vector")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df["vec_id"] % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    a, c = 256 * 256 * 5, 128 * 256 + 128 * 512
    assert got == [(0, 1, 1, a), (0, 2, 8, a), (0, 3, 50, c), (0, 4, 6, 0), (0, 5, 7, -65536), (50, 1, 0, c), (50, 2, 0, c), (50, 3, 1, c), (50, 4, 8, c), (50, 5, 6, 0)]
    assert topk.top_k(df.filter("false"), df["vec_id"] % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [100000.5, 1.0]), (1, [70000.0, 0.0]), (2, [90000.0, -3.0]), (3, [1.3e6] * 64), (4, [-1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = sorted(((sum(x * y for x, y in zip(cells[0], cells[i])), i) for i in range(1, 5)), reverse=True)
    assert [(r.score, r.vec_id) for r in topk.top_k(df, df["vec_id"] == 0, 5).orderBy("rank").collect()] == want
    big = np.full((64, 1), 2**31, dtype=np.int64)
    with pytest.raises(OverflowError):
        topk.branch_and_bound(big.T, np.array([0]), big, np.array([1]), 5, np.full(1, -np.inf))
    assert len(topk.branch_and_bound(big.T, np.array([0]), big, np.array([0]), 5, np.full(1, -np.inf))[0][0]) == 0


def test_branch_and_bound_by_brute_force():
    rng = np.random.default_rng(2)
    c, q = rng.integers(-300, 300, (40, 700)).astype(np.int32), rng.integers(-300, 300, (9, 40)).astype(np.int32)
    ids = rng.permutation(700)
    for i, (found, score) in enumerate(topk.branch_and_bound(q, ids[:9], c, ids, 5, np.full(9, -np.inf))):
        every = q.astype(np.int64) @ c
        order = [j for j in np.lexsort((ids, -every[i])) if ids[j] != ids[i]][:5]
        assert found.tolist() == ids[order].tolist() and score.tolist() == every[i][order].tolist()


@pytest.mark.parametrize("scale", [1, 300, 1e6])
@pytest.mark.parametrize("groups", [None, 3])
def test_blocks_are_read_in_the_tasks(spark, monkeypatch, scale, groups):
    """Scores within 2^23, 2^52 and beyond; blocks are neither joined nor broadcast, as copies of all queries for each group would be."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "LEAST_PAIRS", 4, raising=False)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, n) * scale / 2]) for i, n in zip(rng.integers(0, 120, 150), rng.integers(0, 41, 150))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df["vec_id"] % 3 == 0, 5, groups=groups)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Join|Broadcast|Generate|Cartesian", plan)
    cells = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in cells if i % 3 == 0}):
        vector = min(v for i, v in cells if i == q)
        every = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in cells if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(every[:5])]
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == want


def test_every_pair_of_blocks_has_a_task_of_bounded_size():
    for candidates, queries, cores in itertools.product([0, 1, 2, 51, 703, 14_600, 1_460_000], [0, 1, 5, 57, 1_172, 117_000], [1, 6, 1000]):
        groups, parts = topk._shares(candidates, queries, cores)
        assert 1 <= groups <= max(1, candidates) and 1 <= parts <= max(1, queries) and groups * parts <= 2 * max(4 * cores, topk.TASKS)
        assert candidates * queries / (groups * parts) <= 2 * topk.PAIRS or groups * parts >= topk.TASKS
    sides = [topk.Side(np.arange(256), np.zeros((4096, 256), dtype=np.int16)) for _ in range(7)]
    assert [len(t) for t in topk._turns(iter(sides))] == [2, 2, 2, 1]


def test_branch_and_bound_keeps_ties_at_the_floor():
    rng = np.random.default_rng(3)
    c, q = rng.integers(-2, 3, (64, 400)), rng.integers(-2, 3, (20, 64))
    ids, every = rng.permutation(400), q @ c
    floor = np.sort(every, axis=1)[:, -9].astype(np.float64)
    for scale in (1, 1 << 16, 1 << 26):
        for i, (found, score) in enumerate(topk.branch_and_bound(q * scale, -1 - np.arange(20), c * scale, ids, 5, floor * scale * scale)):
            order = np.lexsort((ids, -every[i]))[:5]
            assert found.tolist() == ids[order].tolist() and score.tolist() == (every[i][order] * scale * scale).tolist()
    above = topk.branch_and_bound(q, -1 - np.arange(20), c, ids, 5, every.max(axis=1) + 1.0)
    assert not any(len(found) for found, _ in above)


def test_operators_on_awkward_rows(spark, awkward, empty):
    model = quality.fit_quality(awkward, awkward.select("doc_id"))
    assert quality.score_quality(awkward, model).count() == awkward.count() and quality.keep_good(awkward, model).columns == awkward.columns
    assert quality.score_quality(empty, quality.fit_quality(empty, empty)).count() == 0
    from pyspark.sql import functions as F

    scores = lm.lm_scores(awkward, F.when(F.col("doc_id") == 5, 0).otherwise(1)).toArrow().to_pylist()
    assert len(scores) == awkward.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in scores)
    assert lm.lm_scores(empty, F.lit(1)).count() == 0
    assert all(r["n_known"] == 0 for r in lm.lm_scores(awkward, F.lit(0)).toArrow().to_pylist())
    got = nearjoin.shingle_classes(awkward).toArrow().to_pylist()
    rows = [(r.doc_id, shingles(r.text)) for r in awkward.select("doc_id", "text").collect()]
    want = [(d, len(s), k if s else d) for (d, s), k in zip(rows, classes(rows))]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert ordermin.order_minhash(awkward).count() == awkward.count()
