"""Classifier, personal data, WARC records, embeddings and packing."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import reachable

from clinicframe.llm import embedding_dedup, pattern_packing, pii_disclosure, quality_classifier, tokens, warc_chunks


def pattern_spans(text):
    """The patterns as they are written down."""
    plain = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(plain(m)) <= 19 and luhn(plain(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(plain(m)) <= 15]


def luhn(number):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(number))) % 10 == 0


def test_patterns_on_random_texts():
    draw = random.Random(5)
    for alphabet in ("aB1.@ -+()9é5\n0", "14 -.5+"):
        for _ in range(4000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
            assert pii_disclosure.base_spans(text) == pattern_spans(text), text
    assert pii_disclosure.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_terms_that_reveal_an_entity(documents):
    filler = lambda k: " ".join(f"n{(k * 7 + j) % 90}" for j in range(12))
    rows = [(k, f"{filler(k)} Zorblax wrote from zed@mail.example.com today {filler(k + 1)}", "s") for k in range(6)]
    rows += [(100 + k, f"{filler(k)} today {filler(k + 3)}", "s") for k in range(60)] + [(200, None, "s"), (201, "", "s"), (None, "x@y.z", "s")]
    got = {r["doc_id"]: r for r in pii_disclosure.digest(documents(*rows)).collect()}
    text = rows[0][1]
    at = text.index("Zorblax")
    assert f"remove:{at}:{at + 7}" in got[0]["spans"] and "today" in text
    assert f":{text.index('today')}:" not in got[0]["spans"]
    assert all(not got[i]["spans"] for i in [*range(100, 160), 200, 201])
    for i, t, _ in rows:
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in pattern_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and got[i]["spans"].startswith(listed)
    clean = {r["doc_id"]: r["text"] for r in pii_disclosure.sanitised(documents(*rows)).collect()}
    assert "Zorblax" not in clean[0] and "[email]" in clean[0] and clean[100] == rows[6][1]
    assert pii_disclosure.digest(documents()).count() == 0


def common_words(k, n=12):
    return " ".join(f"n{(k * 7 + j) % 90}" for j in range(n))


def test_disclosing_terms_are_marked_wherever_they_stand(documents):
    rows = [(k, f"{common_words(k)} Zorblax wrote from zed@mail.example.com {common_words(k + 1)}", "s") for k in range(6)]
    rows[0] = (0, rows[0][1] + " " + common_words(3, 40) + " (Zorblax)", "s")
    rows += [(100 + k, f"{common_words(k)} {common_words(k + 3)}", "s") for k in range(300)]
    rows += [(500, f"{common_words(2)} zorblax, {common_words(5)} Zorblax", "s"), (501, f"{common_words(4)} Quaxley asks ann@rare.example.org {common_words(6)}", "s")]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii_disclosure.digest(documents(*rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    for i, word in ((0, "Zorblax wrote"), (0, "(Zorblax)"), (500, "zorblax,"), (500, "Zorblax")):
        at = texts[i].index(word)
        assert f"remove:{at}:{at + len(word.split()[0])}" in got[i]
    at = texts[501].index("Quaxley")
    assert f"generalise:{at}:{at + 7}" in got[501]
    assert all(got[100 + k] == [""] for k in range(300))


def test_each_text_is_cleaned_by_its_own_spans(documents):
    texts = [f"{common_words(k)} {'pad ' * k}from p{k}@mail.example.com {common_words(k + 1)}" for k in range(8)]
    rows = [(None, t, "s") for t in texts[:4]] + [(None, None, "s"), (None, texts[0], "s"), *((9, t, "s") for t in texts[4:])]
    got = [(r["doc_id"], r["text"]) for r in pii_disclosure.sanitised(documents(*rows)).collect()]
    assert len(got) == len(rows) and sum(not t for _, t in got) == 1
    assert all("@" not in t and t.count("[email]") == 1 for _, t in got if t)
    assert sorted(i is None for i, _ in got) == sorted(i is None for i, _, _ in rows)


def test_classifier_on_held_out_documents(spark, documents):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    rows, quality = [], {}
    for k in range(900):
        words = [word() for _ in range(draw.randint(20, 200))]
        bad = k % 6 == 0
        rows.append((k, " ".join(w.upper() + "!!" if bad else w for w in words) + ".", "s"))
        quality[k] = 0 if bad else 1
    rows += [(None, None, "s"), (2000, "", "s"), (2001, "x" * 300_000, "s"), (5, rows[5][1], "s")]
    labels = spark.createDataFrame([(k, q) for k, q in quality.items() if k % 3 < 2] + [(4, 1), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.scored(documents(*rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    fold = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert len(fold) > 100 and sum(r["predicted"] == quality[r["doc_id"]] for r in fold) >= 0.95 * len(fold)
    assert quality_classifier.scored(documents(), labels).count() == 0
    assert {r["score"] for r in quality_classifier.scored(documents(*rows[:3]), labels.limit(0)).collect()} == {0.5}


def test_each_row_is_kept_by_its_own_text(spark, documents):
    draw = random.Random(3)
    text = lambda bad: " ".join((w.upper() + "!!" if bad else w) for w in ("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(60))) + "."
    rows = [(k, text(k % 6 == 0), "s") for k in range(300)] + [(None, text(k % 2), "s") for k in range(20)] + [(7, text(True), "s"), (6, text(False), "s")]
    labels = spark.createDataFrame([(k, int(k % 6 > 0)) for k in range(300)], "doc_id long, quality int")
    kept = quality_classifier.keep_good(documents(*rows), labels)
    assert kept.columns == documents().columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t, _ in rows if "!" not in t), key=repr)
    assert quality_classifier.keep_good(documents(), labels).count() == 0


def test_prior_from_scores():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        good, bad = draw.normal(2, 1, 8000), draw.normal(-2, 1, 4000)
        unlabelled = np.concatenate([good[:4000][: int(4000 * share)], bad[: int(4000 * (1 - share))]])
        assert quality_classifier.estimate_prior(good[4000:], unlabelled) == pytest.approx(share, abs=0.08)


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_archives_round_trip(spark, tmp_path, chunk):
    long = "é" * 5000
    pages = [(1, "u", long), (2, None, long), (3, "u\r\nx", "short"), (4, "u", "short"), (None, "u", None), (5, "u", ""), (6, "u", "a\r\n\r\nb" * 300), (6, "u", "a\r\n\r\nb" * 300)]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, archive string, record int")
    warc_chunks.write_archives(table, str(tmp_path / "a"), chunk)
    got = sorted((tuple(r) for r in warc_chunks.read_archives(spark, str(tmp_path / "a")).collect()), key=repr)
    expected = []
    for i, _, html in pages:
        data = (html or "").encode()
        leader = max((j for j, _, h in pages if (h or "") == (html or "")), key=lambda j: -1 if j is None else j)
        revisit = len(data) >= 1000 and leader != i
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", leader if revisit else None))
    assert got == sorted(expected, key=repr)
    rows = spark.read.parquet(str(tmp_path / "a")).orderBy("archive", "record", "chunk").collect()
    assert max(len(r["bytes"]) for r in rows if r["chunk"]) <= chunk
    stream = b"".join(bytes(r["bytes"]) for r in rows)
    count = 0
    while stream:  # the rows in order are a WARC file
        head, _, rest = stream.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head).group(1))
        block, stream = rest[:n], rest[n:]
        assert head.startswith(b"WARC/1.1\r\n") and stream.startswith(b"\r\n\r\n")
        stream = stream[4:]
        digest = re.search(rb"sha1:(\w+)", head).group(1)
        if b"WARC-Type: response" in head:
            assert base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()) == digest
        count += 1
    assert count == len(pages)
    broken = spark.read.parquet(str(tmp_path / "a")).filter("chunk <> 1 or payload_upto = 0")
    broken.write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged"):
        warc_chunks.read_archives(spark, str(tmp_path / "b")).collect()


def test_payloads_are_encoded_in_slices():
    class Watched(str):
        def encode(self, *_):
            raise AssertionError("encoded whole")

    text = Watched("aé中😀" * 70_000)
    whole = str.encode(text)
    pieces = list(warc_chunks.chunked(text, 1000))
    assert b"".join(p for p, _, _ in pieces) == whole and {len(p) for p, _, _ in pieces[:-1]} == {1000}
    assert pieces[-1][1:] == (len(whole), hashlib.sha1(whole).digest())


def test_archives_are_stored_and_dealt_compressed(spark, tmp_path):
    table = spark.createDataFrame([(k, "u", common_words(k, 400)) for k in range(20)], "page_id long, url string, html string")
    warc_chunks.write_archives(table, str(tmp_path / "c"))
    assert all(p.name.endswith(".zstd.parquet") for p in (tmp_path / "c").rglob("part-*"))
    rows = spark.read.parquet(str(tmp_path / "c")).toPandas()
    small = next(warc_chunks.packed(iter([rows])))
    assert small["bytes"].map(len).sum() < rows["bytes"].map(len).sum() / 2
    plan = warc_chunks.read_archives(spark, str(tmp_path / "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "packed" in plan[plan.index("RepartitionByExpression"):]


def test_empty_archive(spark, tmp_path):
    warc_chunks.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc_chunks.read_archives(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("tile_rows", [16, 1024])
def test_near_embeddings(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile_rows)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 24))
    rows = []
    for k in range(220):
        v = (centres[k % 12] + draw.normal(scale=0.28, size=24)) * (1 + k % 3)
        rows.append((k, [float(x) for x in v], None if k % 40 == 0 else k % 2))
    rows += [(300 + k, rows[7][1], 1) for k in range(6)] + [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [1.0], 1), (404, [2.0], 1)]
    rows += [(405, [None, 1.0], 0), (406, [float("inf"), 1.0], 0), (7, rows[7][1], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for x, (_, u, a) in enumerate(rows):
        for y in range(x):
            _, v, b = rows[y]
            if a is not None and a == b and usable(u) and usable(v) and len(u) == len(v):
                p, q = np.array(u), np.array(v)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links.append((x, y))
    assert 100 < len(links)
    groups = reachable([r[0] for r in rows], [(rows[x][0], rows[y][0]) for x, y in links])
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    expected = sorted((r[0], int(n), groups[r[0]], groups[r[0]] == r[0]) for r, n in zip(rows, count))
    assert sorted(tuple(r) for r in embedding_dedup.near_copies(table).collect()) == expected
    assert embedding_dedup.near_copies(table.limit(0)).count() == 0


@pytest.mark.parametrize("tile_rows", [2, 1024])
def test_embeddings_without_identifier(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile_rows)
    axis = lambda k, tilt=0.0: [tilt if j == 15 else float(j == k) for j in range(16)]
    rows = [(1, axis(0)), (2, axis(1)), (None, axis(0, 0.1)), (None, axis(1, 0.1)), (None, axis(2)), (None, axis(2)), (None, axis(2, 0.1)), (3, axis(3)), (3, axis(4)), (4, axis(4, 0.1))]
    rows += [(None, axis(k)) for k in range(5, 15)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    expected = [(1, 1, 1, True), (2, 1, 2, True), (None, 1, 1, False), (None, 1, 2, False), *[(None, 2, None, True)] * 3, (3, 0, 3, True), (3, 1, 3, True), (4, 1, 3, False)]
    expected += [(None, 0, None, True)] * 10
    assert sorted((tuple(r) for r in embedding_dedup.near_copies(table).collect()), key=repr) == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_remembered_words_give_the_same_ids(tokenizer):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    exact.encode_special_tokens = True
    fast = tokens.Encoder(tokenizer)
    draw = random.Random(8)
    texts = ["", " ", "a  b", "a \n b", " a", "a ", "\n", "x\ty z w", "it's don't <|endoftext|> 中文 字", "\r\n a\r\nb  ", "日本 語\nab cd\n", "a \x85b", "q" * 5000]
    texts += ["".join(draw.choice(" \n\t'sab1é中!") for _ in range(30)) for _ in range(1500)]
    for text in texts:
        assert fast.encode(text) == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing_takes_added_tokens_as_the_library_does(documents, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    texts = ["<|endoftext|>", "one two <|endoftext|> three", "a<|endoftext|>b  <|endoftext|>\n", "<|endoftext> plain <|endoftext"]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in pattern_packing.pack(documents(*((k, t, "s") for k, t in enumerate(texts))), tokenizer).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (50256 in ids) == (k < 3)
        data = np.array(ids, "<u4").tobytes() + b"\0\0\0\0"
        assert got[k] == (len(ids) + 1, zlib.crc32(data))


def test_packing(documents, tokenizer):
    draw = random.Random(9)
    rows = [(k, " ".join(f"word{draw.randint(0, 50)}" for _ in range(draw.choice((3, 40, 200, 500)))), "s") for k in range(120)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "many words " * 4000, "s"), (None, "no name", "s"), (3, rows[3][1], "s")]
    got = pattern_packing.pack(documents(*rows), tokenizer, 512).collect()
    encode = tokens.Encoder(tokenizer).encode
    expected = []
    for i, t, _ in rows:
        ids = encode(t or "") + b"\0\0\0\0"
        n = len(ids) // 4
        cuts = [0, *range((n - 1) % 512 + 1, n, 512), n]
        expected += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.05 * -(-total // 512) + 1
    assert pattern_packing.pack(documents(), tokenizer).count() == 0


def test_plan_uses_every_count_once():
    draw = random.Random(10)
    for _ in range(20):
        counts = {draw.randint(1, 64): draw.randint(1, 2000) for _ in range(draw.randint(0, 40))}
        used: dict[int, int] = {}
        for content, many in pattern_packing.plan(counts, 64):
            assert sum(content) <= 64
            for n in content:
                used[n] = used.get(n, 0) + many
        assert used == counts
