"""Conversation repair, legacy archives and token alignment against brute force and on awkward tables."""

import base64
import collections
import gzip
import hashlib
import io
import itertools
import random
import zlib

import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from fluxframe.llm import align, queries, repair, warc

SF = "/root/testdata/sf0.001"
A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


# ---- repair


def damage(rows):
    """Rows (conv_id, turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv_id, turn, role, text in rows:
        shown = [" " if v is None else v for v in (conv_id, turn, role, text)]
        hurt = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(hurt, text)
        out += [(turn, "user" if hurt == 4 else role, text)] * {0: 0, 3: 2}.get(hurt, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def accepted(letters):
    body = letters[1:] if letters[:1] == "s" else letters
    return letters == "" or (body != "" and body == "ua" * (len(body) // 2))


def cheapest(rows, found):
    """All edits of few rows, with at most one row put in at each place and two at the end."""
    best = None
    options = []
    for (_, role, text), fault in zip(rows, found):
        ways = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            late = fault == "truncated"
            ways += [(late, "K", (role, text)), (2 + late, "R", ("user", text)), (2 + late, "R", ("assistant", text))]
        options += [[(0, "", None), (2, "I", ("user", "")), (2, "I", ("assistant", ""))], ways]
    options += [[(0, "", None), (2, "I", ("user", "")), (2, "I", ("assistant", ""))]]
    for choice in itertools.product(*options):
        kept = [row for _, _, row in choice if row]
        if any(not r for r, _ in kept) or not accepted("".join(r[0] for r, _ in kept)):
            continue
        weight = sum(c for c, _, _ in choice), "".join(a for _, a, _ in choice)
        if best is None or weight < best[0]:
            best = weight, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return best


def expected(rows):
    rows = damage(rows)
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    (cost, audit), digest = cheapest(rows, found)
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.toArrow().to_pylist()}


def small_conversations():
    draw = random.Random(3)
    out = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 4)):
            role = draw.choice(["user", "assistant", "system", "tool", "", None])
            out.append((conv, draw.choice([turn, turn * 2, 5, None]), role, draw.choice(["Yes.", "no", " \n", "", None, "What? \t", "ü。"])))
    return out


@pytest.mark.parametrize("most_rows", [1, 2, repair.STRETCH_ROWS])
def test_repairs_by_brute_force(spark, most_rows):
    rows = small_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role AS part", "text AS sha", "1 AS hurt", "2 AS c")
    want = {c: expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert results(repair.repair_conversations(repair.damaged(df), most_rows)) == want


def test_repair_of_the_given_table_in_one_and_many_stretches(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    whole = results(queries.QUERIES["op11_conversation_repair"](spark, SF))
    assert set(whole) == {r.conv_id for r in rows.select("conv_id").distinct().collect()}
    assert results(repair.repair_conversations(repair.damaged(rows), 2)) == whole


def test_long_conversation_and_copies(spark):
    """One conversation has most rows, and one of its rows most of those."""
    text = "x" * 300_000
    rows = [(1, t, ("user", "assistant")[t % 2], f"Line {t}.", 1) for t in range(3000)] + [(1, 1500, "assistant", "Again.", 5000), (2, 0, "user", text, 1), (3, 7, "user", "gone", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    got = results(repair.repair_conversations(df))
    lines = [f"{('user', 'assistant')[t % 2]}:Line {t}." for t in range(3000)]
    lines[1500:1500] = ["user:", "assistant:Again."]  # the first of the copies stays, as a row in front of it costs less than its end
    audit = "K" * 1500 + "IK" + "D" * 4999 + "K" * 1500
    assert got[1] == (0, 0, 4999, 0, 5000, 3 * 4999 + 2, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    # Keeping the cut-off text costs one, and its answer two.
    assert got[2] == (0, 0, 0, 1, 0, 3, "D", hashlib.sha256(b"").hexdigest())
    assert got[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert results(repair.repair_conversations(df.filter("false"))) == {}


def test_agenda_pops_the_lightest():
    rows = [("u", 0), ("u", 0), ("a", repair.TRUNCATED), ("s", 0)]
    ends = repair.lightest(rows, repair.START)
    assert min(ends[q] for q in repair.ACCEPTING if q in ends) == next(iter(repair.lightest(rows, repair.START, repair.ACCEPTING).values()))


# ---- archives


def test_archives_of_copies(spark):
    big, more, small = "é" * 700, "b" * 1000, "c" * 999
    rows = [(1, "http://a/", big), (2, "http://a/ x\ny", big), (9, None, big), (4, "http://b/", more), (None, "u", more), (5, "x", small), (6, "x", small), (7, "", None), (7, "", ""), (8, "h", more), (8, "h", more),
            (10, "http://c/", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS path", "html AS digest", "1 AS place", "2 AS payload")
    found = warc.archive_pages(pages).toArrow().to_pylist()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    last = {1: 9, 2: 9, 4: 8, None: 8}
    want = [(p, size(t), sha(t), "revisit" if p in last else "response", last.get(p)) for p, _, t in rows]
    eight = [i for i, w in enumerate(want) if w[0] == 8]
    want[eight[0]] = (8, 1000, sha(more), "revisit", 8)  # of rows with one page_id one stays
    assert got == sorted(want, key=repr)
    assert {r["target_uri"] for r in found if r["page_id"] in (2, 9)} == {"http://a/%20x%0Ay", None}
    assert warc.archive_pages(pages.filter("false")).count() == 0


def test_many_files_and_long_pages(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('p', id % 250), if(id = 3, 1000000, 800)) AS html")
    arcs, folder = warc.write_arc(pages, file_bytes=4000)
    assert arcs.count() > 8 and arcs.agg({"records": "sum"}).first()[0] == 300
    index = warc.index_arc(arcs, folder)
    assert {r.names.count(" ") for r in index.select("names").distinct().collect()} == {4, 9}
    files, place = warc.convert_arc(warc.revisited(index), folder, file_bytes=4000)
    records = warc.read_warc(files, place, payloads=True)
    assert records.rdd.getNumPartitions() > 1
    got = {r["page_id"]: r for r in records.toArrow().to_pylist()}
    assert len(got) == 300 and sum(r["record_type"] == "revisit" for r in got.values()) == 50 - 1  # page 3 alone is longer
    assert got[3]["payload"] == b"p3" * 1_000_000 and got[299]["payload"] == b"p49" * 800


def test_foreign_archives():
    """Header lines as others write them: both versions, blanks in a URL, odd dates, documents that hold archive lines, no HTTP."""
    one = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n\n"
    head = b"filedesc://x.arc 0.0.0.0 19970102030405 text/plain %d\n" % len(one)
    block, names = warc.split_arc_record(head + one + b"\n", None)
    assert block["Archive-date"] == "19970102030405" and warc.arc_names(names) == warc.ARC_FIELDS[1]
    body = b"HTTP/1.0 200 OK\nA: b\n\nhttp://q 1.2.3.4 19970102030405 text/html 3\nabc"
    record = b"\nhttp://a/b c 1.2.3.4 1997 text/html %d\n" % len(body) + body + b"\n"
    fields, document = warc.split_arc_record(record, warc.ARC_FIELDS[1])
    assert fields["URL"] == "http://a/b c" and document == body
    raw = warc.converted(fields, document, "<urn:uuid:1>", None)
    head, block = warc.split_warc_record(raw)
    assert (head["WARC-Type"], head["WARC-Date"], head["WARC-IP-Address"], head["Content-Type"]) == ("response", "1997-01-01T00:00:00Z", "1.2.3.4", warc.HTTP_RESPONSE) and block == body
    payload = body.split(b"\n\n", 1)[1]
    assert base64.b32decode(head["WARC-Payload-Digest"][5:]) == hashlib.sha1(payload).digest()
    dns, document = warc.split_arc_record(b"dns:a.org 9.9.9.9 20010203040506 text/dns 200 - - 7 f.arc 5\nhosts\n", warc.ARC_FIELDS[2])
    assert b"WARC-Type: response\r\n" in warc.converted(dns, document, "<urn:uuid:2>", None)
    ftp, document = warc.split_arc_record(b"ftp://a/ 9.9.9.9 20010299040506 text/plain 5\nhosts\n", warc.ARC_FIELDS[1])
    raw = warc.converted(ftp, document, "<urn:uuid:3>", None)
    assert b"WARC-Type: resource\r\n" in raw and b"WARC-Date: 2000-01-01T00:00:00Z\r\n" in raw
    again = warc.split_warc_record(warc.converted(fields, body, "<urn:uuid:4>", "<urn:uuid:1>"))
    assert again[0]["WARC-Refers-To"] == "<urn:uuid:1>" and again[1] == b"HTTP/1.0 200 OK\nA: b\n\n"
    for bad in (record[:-8], b"no header\n"):
        with pytest.raises(ValueError):
            warc.split_arc_record(bad, warc.ARC_FIELDS[1])
    with pytest.raises(ValueError):
        warc.split_warc_record(raw.replace(b"hosts", b"hostS"))
    packed = warc.gzip_member(b"one") + gzip.compress(b"two" * 10**6)
    found = list(warc.members(io.BytesIO(packed)))
    assert [(p, packed[p : p + n]) and t for p, n, t in found] == [b"one", b"two" * 10**6] and found[1][0] + found[1][1] == len(packed)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[:-9])))


# ---- alignment


def token_bytes():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_of_letter()

    def both(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return ([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in x],
                [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in y])

    return both


def aligned(both, text):
    """Groups and links of one text, token by token."""
    if not text:
        return None
    a, b = both(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    spans = []
    for side in (a, b):
        at, out = 0, []
        for i, raw in side:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        spans.append(out)
    ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    groups, links, at = [], collections.Counter(), [0, 0]
    for end in ends:
        parts = []
        for k, side in enumerate(spans):
            first = at[k]
            while at[k] < len(side) and side[at[k]][2] <= end:
                at[k] += 1
            parts.append(side[first : at[k]])
        groups.append(tuple([i for i, *_ in p] for p in parts))
        links.update((i, j) for i, s, e in parts[0] for j, t, f in parts[1] if s < f and t < e)
    return a, b, groups, links


def check_alignment(got, texts):
    both = token_bytes()
    found = [aligned(both, t) for t in texts]
    counts = collections.Counter(p for f in found if f for p in f[3])
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = []
    for f in found:
        if f is None:
            want.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()),
                     hashlib.sha256(written.encode()).hexdigest()))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in names)) for r in got)


def test_alignment_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500").collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = align.align_documents(df, A, B).toArrow().to_pylist()
    assert {r["doc_id"] for r in got} == {r.doc_id for r in rows}
    check_alignment(got, [r.text for r in rows])


def test_alignment_of_awkward_texts(spark, awkward, empty):
    texts = [r.text for r in awkward.collect()]
    check_alignment(align.align_documents(awkward, A, B).toArrow().to_pylist(), [t for t in texts])
    odd = ["a ▁ b", "<s> x </s> <unk> <0x41>", "<|endoftext|>", "  two  blanks ", "\n\n\t x", "日本 語 é 👩‍👩‍👧", "x" * 300, "don't we'll", " lead", "trail ", "\u0000 nul", "ﬁ ½ Å"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    check_alignment(align.align_documents(df, A, B).toArrow().to_pylist(), odd)
    assert align.align_documents(empty, A, B).count() == 0


def test_long_text_is_aligned_in_slices(monkeypatch):
    aligner = align.Aligner(A, B)
    text = " ".join(f"wörd{i % 97} and, so on" for i in range(400))
    whole = aligner.align([text, None, text + " x"])
    monkeypatch.setattr(align, "SLICE_BYTES", 50)
    monkeypatch.setattr(align, "REMEMBER", 10)
    parts = align.Aligner(A, B)
    figures, digests, key, times = parts.align([text, None, text + " x"])
    assert (figures == whole[0]).all() and digests == whole[1]
    pairs = lambda who, key, times: sorted(zip((key >> 32).tolist(), who.codes[key & 0xFFFFFFFF].tolist(), times.tolist()))
    assert pairs(parts, key, times) == pairs(aligner, whole[2], whole[3])


def test_coalescing_of_ranges():
    import numpy as np

    assert align.coalesce(np.array([0, 3, 5, 0, 1, 6]), np.array([3, 5, 9, 1, 5, 9]), np.array([0, 0, 0, 1, 1, 1])).tolist() == [0, 0, 1, 0, 0, 1]
    a, b = align.overlaps(np.array([3, 5, 9]), np.array([1, 5, 9]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_token_files_are_read_in_many_tasks(spark):
    from fluxframe.llm import tokenio
    from fluxframe.session import shared_folder

    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 3000) AS text")
    files = tokenio.write_token_files(docs, path("word_bpe_49k.json"), file_bytes=500)
    got = tokenio.read_token_files(files, shared_folder(spark))
    assert files.count() > 8 and got.rdd.getNumPartitions() >= 8
    rows = sorted((r.doc_id, r.start, r.n_tokens) for r in got.select("doc_id", "start", "n_tokens").collect())
    assert [r[0] for r in rows] == list(range(400)) and all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))
