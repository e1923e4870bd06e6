"""Small tables with nulls, empty texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furlong.llm import components, decontaminate, html_text, lines, minhash, packing, quality, records, store, suffixes, tokens, toxicity, warc
from furlong.llm import edits as edit_search
from furlong.llm.edits import within

SCHEMA = "doc_id long, text string, lang string, n_chars long, a long, id long, line long, bucket long"
BASE = " ".join(f"word{i} and more{i * 7 % 13}" for i in range(60))
NEAR = BASE.replace("word7 ", "changed ")
TEXTS = [(1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, "x" * 300), (9, BASE + "\n" + NEAR), (10, "  \n\n \t "), (11, "ab " * 200), (None, BASE), (12, "é" * 250 + "\n" + BASE[:150]), (6, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0, 9, 9, 9, 9) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("ordinary", [False, True])
def test_tokens_equal_the_library(ordinary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary())
    plain.encode_special_tokens = ordinary
    texts = [t or "" for _, t in TEXTS] + ["a  b", "a   b", "a\n\n\nb ", " lead", "trail ", "it's, he'd.", "x  y", "<|endoftext|>", "see <|endoftext|> here, and<|endoftext|>.", "a\x01b c", "\n", "a \n b", "1,000.5 ok?!", "a\r\nb", "ß. ǅ,", "a\u00a0 b\u00a0", " \u00a0x", "a\x85\x85\x85b", "(half) \"said\" -- x's'", "²³. 中文。, ½!", " . , ", "word''s 'll"]
    coder = tokens.Encoder(tokens.vocabulary(), ordinary)
    for some in (texts, texts[::-1], [*texts, None]):
        ids, bounds = coder.encode(pa.array(some, pa.string()))
        for text, i, j in zip(some, bounds[:-1], bounds[1:], strict=True):
            assert ids[i:j].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_tokens_when_pieces_are_forgotten(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    plain, coder = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    for k in range(12):
        texts = [" ".join(f"w{(k * 7 + i) % 40}x{i % 3}." for i in range(30)), "and so on, " * k]
        ids, bounds = coder.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t).ids for t in texts]


def test_records_round_trip(spark, docs, empty):
    shards = records.write_records(docs, store.new_path(spark, "t"), tokens.vocabulary(), shards=3)
    got = records.read_records(shards, seed=4).collect()
    assert len(got) == len(TEXTS) and sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, _ in TEXTS if i is not None)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids"][-1] == 2 and r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert records.token_records(spark, empty, tokens.vocabulary()).count() == 0
    with pytest.raises(ValueError):
        records.unframe(lambda n: b"\x05" + b"\0" * (n - 1))


def test_packing(docs, empty):
    got = packing.pack(docs, tokens.vocabulary(), longest=64, batch_tokens=128).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["length"] & r["length"] - 1 == 0 and r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["offset"] == 0 for r in got)
    for i in (1, 4, 8, 9):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] and own[-1]["ids"][-1] == 1 and [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
    # A batch has sequences of one length, and all but the last of a bucket in a partition are full.
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r["length"])
    assert all(len(set(x)) == 1 and sum(x) <= 128 for x in batches.values()) and any(sum(x) == 128 for x in batches.values())
    assert packing.pack(empty, tokens.vocabulary()).count() == 0


def test_binary_lengths():
    totals = np.array([1, 64, 65, 200, 63])
    lengths, owner = packing.binary_lengths(totals, 64)
    assert lengths[owner == 3].tolist() == [64, 64, 64, 8] and np.bincount(owner, lengths).tolist() == totals.tolist() and lengths[owner == 4].tolist() == [32, 16, 8, 4, 2, 1]


def test_minhash(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    sets = {}
    for i, t in TEXTS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets if i is not None}
    for _ in comp:
        for x in comp:
            for y in comp:
                if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    comp[x] = comp[y] = min(comp[x], comp[y])
    assert got == {(i, len(sets[i]), comp[i], comp[i] == i) for i in comp}
    assert minhash.near_duplicates(empty).count() == 0


def test_sketches_fill_and_estimate():
    a, b = np.arange(1, 301, dtype=np.uint64), np.arange(76, 376, dtype=np.uint64)
    rows = minhash.sketches(np.concatenate((a, b, a[:1])), np.array([0, 300, 600, 601, 601]), 128)
    top = np.uint64(2**64 - 1)
    assert (rows[:3] != top).all() and (rows[3] == top).all() and abs((rows[0] == rows[1]).mean() - 225 / 375) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 300)] + [(500, i) for i in range(501, 560)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[105] == 100 and got[300] == 200 and got[559] == 500


@pytest.mark.parametrize("rows, local", [(400_000, 2_000), (5, 1)])
def test_suffixes(docs, empty, monkeypatch, rows, local):
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", rows)
    monkeypatch.setattr(suffixes, "LOCAL_BLOCKS", local)
    seen, want = set(), {}
    unique = {i: t for i, t in TEXTS if i is not None}
    for i in sorted(unique):
        b = (unique[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).where("doc_id is not null").collect()}
    assert got == want
    assert suffixes.remove_repeats(empty).count() == 0


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect() if r["doc_id"] is not None}
    for i, t in TEXTS:
        if i is not None:
            assert (got[i]["n_words"], got[i]["word_chars"]) == (len(words(t)), sum(map(len, words(t))))
    assert not got[1]["base_failed"] and not got[4]["kept"] and got[11]["n_repeat_words"] == 200 and got[11]["base_failed"]
    assert sorted(r["doc_id"] or 0 for r in quality.keep_good(docs).collect()) == sorted([r["doc_id"] for r in got.values() if r["kept"]] + [0] * got[1]["kept"])
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def test_compression_bands():
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rng = np.random.default_rng(5)
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(3000)).encode()
    assert quality.ratio_verdict(compress, prose)[2] and quality.ratio_verdict(compress, b"")[2]
    assert not quality.ratio_verdict(compress, b"again and again " * 500)[2]
    assert not quality.ratio_verdict(compress, rng.bytes(9000))[2]
    assert not quality.ratio_verdict(compress, prose[:9000] + b"the same words " * 1000)[2]


@pytest.mark.parametrize("size", [128, 512, 1024, 4096, 16384, 65536, 150000])
def test_repetition_in_every_band(size):
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rng = np.random.default_rng(size)
    prose = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(size // 3)]
    assert quality.ratio_verdict(compress, " ".join(prose).encode()[:size])[2]
    for times in (5, 6, 7):
        assert not quality.ratio_verdict(compress, " ".join(x for x in prose for _ in range(times)).encode()[:size])[2]
    line = " ".join(prose)[:30] + "\n"
    assert not quality.ratio_verdict(compress, (line * size)[:size].encode())[2]


def test_first_chunk_and_tail_are_checked():
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rng = np.random.default_rng(6)
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(4000)).encode()
    again = b"the same words " * 1000
    assert quality.ratio_verdict(compress, prose[:6000])[2] and quality.ratio_verdict(compress, prose[:4097])[2]
    assert not quality.ratio_verdict(compress, prose[:4096] + again[:3000])[2]
    assert not quality.ratio_verdict(compress, again[:4096] + prose[:3500])[2]


def test_toxicity(spark, docs, empty):
    clean = [(i, f"The weather in town{i} is fine today. People walk by the river{i % 7}.") for i in range(400)]
    bad = [(i, f"The weather in town{i} is fine today.\nYou are a grumbly{i % 3} fool. People walk.") for i in range(400, 520)]
    texts = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(520)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(texts, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] >= 400) for r in got) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    model = toxicity.fit_texts([t for _, t in clean + bad], np.array([0.0] * 400 + [1.0] * 120))
    found = toxicity.score(spark.createDataFrame([bad[0]], "doc_id long, text string"), model).first()["sentences"]
    assert [bad[0][1][s["start"] : s["end"]] for s in found] == ["You are a grumbly1 fool."]
    assert toxicity.score(docs, model).count() == len(TEXTS) and toxicity.score(empty, model).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).count() == len(TEXTS)


def test_warc(spark):
    rows = [(1, "http://a.example.com/x?q=1#top", "<p>é</p>"), (5, "https://b.example.com/", "<p>é</p>"), (3, None, None), (4, "", ""), (9, "http://a.example.com/x?q=1", "other"), (None, "http://c.org", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()}
    assert got == {1: (9, "revisit", 5), 5: (9, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 9: (5, "response", None), None: (9, "revisit", 5)}
    shards = warc.write_archives(pages, store.new_path(spark, "w"))
    found = warc.lookup(shards, spark.createDataFrame([("http://a.example.com/x?q=1",), ("http://no.example.com/",), (None,)], "url string")).collect()
    assert sorted(r["page_id"] for r in found) == [1, 9] and warc.archived(pages.limit(0)).count() == 0


def test_html(spark):
    story = "".join(f"<p>Sentence {i} of the story, with some length, and a few commas, to read.</p>" for i in range(6))
    page = f"<html><body><div id=menu><a href=/>Home</a></div><div class='cookie-notice'><p>We use cookies, and so on, and so on.</p></div><div><div class=x><h1>Ti&amp;tle</h1>{story}</div><div class=comments><p>First, what a story, this is long enough, surely.</p></div></div><form>mail</form><footer>c</footer></body></html>"
    text = html_text.main_text(page)
    assert text.split("\n")[0] == "Ti&tle" and text.count("Sentence") == 6 and not re.search("cookies|First|mail|Home", text)
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "plain  text"), (None, "u", "<p>x<p>y"), (4, "u", "<div <p> a < b")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "plain text" and got[None] == "x\ny"


def test_lines(docs, empty):
    got = {r["doc_id"]: r["dropped"] for r in lines.repeated_lines(docs).collect()}
    assert got[2] == [0] and 0 in got[9]
    out = lines.dedup_lines(docs)
    assert {r["doc_id"] for r in out.collect()} >= {1, 4, 5, 6, 10, None} and lines.dedup_lines(empty).count() == 0
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and lines.dedup_lines(docs, counts=False, length_col="n_chars").columns == docs.columns


def test_decontamination(spark, docs, empty):
    item = "Where does the quiet river bend before the old stone bridge? It bends near the mill of seven sisters."
    items = spark.createDataFrame([(1, item), (2, "Who wrote the long letter about ships and harbours? A sailor did so."), (3, None), (4, "...")], "item_id long, text string")
    rows = [(1, "So much talk. " * 90 + item.upper() + " And on it goes."), (2, "The river is quiet and the bridge is old."), (3, None), (None, item), (4, item[:58])]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.contaminated(texts, items).collect())
    assert got == [(0, 1), (1, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(texts, items).collect()) == [2, 3, 4]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(empty, items).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.agg(F.sum("length")).first()[0] > 1000


def test_pairs_in_buckets(spark):
    rng = np.random.default_rng(5)
    rows = [(int(b), i, int(s)) for i, (b, s) in enumerate(zip(np.concatenate((rng.integers(0, 60, 300), np.full(90, 30))), rng.integers(0, 16, 390), strict=True))]
    near = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = components.pairs_in_buckets(spark.createDataFrame(rows + rows[:50], "bucket long, id long, sig long"), near).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_bucket = {}
    for b, i, s in rows:
        by_bucket.setdefault(b, []).append((i, s))
    want = {(min(i, j), max(i, j)) for own in by_bucket.values() if len(own) <= components.SMALL for i, s in own for j, t in own if i < j and bin(s ^ t).count("1") <= 1}
    assert {(r["head"], r["id"]) for r in found if not r["big"]} == want
    large = {(b, i) for b, own in by_bucket.items() if len(own) > components.SMALL for i, _ in own}
    assert large and {(r["bucket"], r["id"]) for r in found if r["big"]} == large and all(r["head"] == min(i for i, _ in by_bucket[r["bucket"]]) for r in found if r["big"])


def test_bucket_links_lose_none(spark):
    rng = np.random.default_rng(9)
    value = rng.integers(0, 400, 160)
    rows = [(b, i, int(v)) for i, v in enumerate(value) for b in (1, 2 + i % 3)]
    members = store.stored(components.colliding(spark.createDataFrame(rows, "bucket long, id long, sig long")), "m")
    pairs = []

    def confirm(asked):
        some = [tuple(r) for r in asked.collect()]
        pairs.extend(some)
        return spark.createDataFrame([p for p in some if abs(value[p[0]] - value[p[1]]) <= 2], "a long, b long")

    links = components.bucket_links(members, confirm, lambda x, y: F.abs(x - y) <= 5)
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    comp = list(range(len(value)))
    for _ in range(20):
        for i in range(len(value)):
            for j in range(len(value)):
                if abs(value[i] - value[j]) <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got.get(i, i) for i in range(len(value))] == comp and len(pairs) < 160 * 159 / 4


def edits(a, b):
    """Edit distance, row by row."""
    row = np.arange(len(b) + 1)
    other = np.array([ord(c) for c in b])
    for i, c in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (other != ord(c)))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def similar(a, b, least=0.9):
    most = int(max(len(a), len(b)) * (1 - least) + 1e-9)
    return abs(len(a) - len(b)) <= most and edits(a, b) <= most


def groups_of(lines):
    """Group of each line by brute force: the number of its first member."""
    component = list(range(len(lines)))
    pairs = [(i, j) for j in range(len(lines)) for i in range(j) if similar(lines[i], lines[j])]
    for _ in lines:
        before = component[:]
        for i, j in pairs:
            component[i] = component[j] = min(component[i], component[j])
        if component == before:
            break
    return component


def test_edits(monkeypatch):
    assert (edits("kitten", "sitting"), edits("abc", "abc"), edits("", "ab"), edits("ab", "")) == (3, 0, 2, 2)
    rng = np.random.default_rng(8)
    x, y, most = [""], ["ab"], [2]
    for k in range(400):
        line = list(rng.choice(list("abcdé "), rng.choice([1, 3, 40, 63, 64, 65, 128, 129, 330])))
        x.append("".join(line))
        for _ in range(rng.integers(0, 1 + len(line) // 6)):
            at = rng.integers(len(line) + 1)
            line[at : at + rng.integers(3)] = rng.choice(list("xyab "), rng.integers(3))
        y.append("".join(line))
        most.append(int(rng.choice([0, 2, max(len(x[-1]), len(y[-1])) // 10, max(len(x[-1]), len(y[-1])) // 5])))
    want = [edits(a, b) <= n for a, b, n in zip(x, y, most, strict=True)]
    assert any(want) and not all(want) and within(x, y, np.array(most)).tolist() == want
    # The same by other groups, and with each pair by itself.
    monkeypatch.setattr(edit_search, "CELLS", 8)
    assert within(x, y, np.array(most)).tolist() == want
    monkeypatch.setattr(edit_search, "LONG", 0)
    monkeypatch.setattr(edit_search, "STEP", 7)
    assert within(x, y, np.array(most)).tolist() == want
    assert not any(edit_search.word_by_word(a, b, n) and not w for a, b, n, w in zip(x, y, most, want, strict=True))


def test_near_lines_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(400)]
    texts = []
    for n in (3, 5, 8, 12, 20, 30, 60, 150):
        for _ in range(12):
            line = list(rng.choice(vocabulary, n))
            texts.append(" ".join(line))
            for _ in range(max(1, n // 20)):
                line[rng.integers(n)] = rng.choice(vocabulary)
            texts.append(" ".join(line))
            texts.append(texts[-1][:-1])
    got = {r["doc_id"] for r in lines.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i for i, c in enumerate(groups_of(texts)) if c < i}
    assert len(want) > 100 and len(got & want) >= 0.98 * len(want) and got <= want


def test_a_crowd_of_near_lines(spark):
    """A bucket of more lines than are compared while it is read; most are joined by the line they were made from."""
    rng = np.random.default_rng(4)
    base = list(rng.choice(["".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(50)], 40))
    texts = [" ".join(base)]
    for k in range(299):
        line = base[:]
        for at in rng.choice(40, 1 + k % 3, replace=False):
            line[at] = f"new{chr(97 + k % 26)}{chr(97 + k // 26)}"
        texts.append(" ".join(line))
    got = lines.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 299


@pytest.mark.parametrize("rows", [None, 20])
def test_lines_with_a_passage_in_common(spark, monkeypatch, rows):
    """Lines that share most of a long passage and little else meet in crowded buckets, but no table has all their pairs."""
    if rows:
        monkeypatch.setattr(lines, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(3, 9)))
    passage = " ".join(word() for _ in range(24))
    texts, want = [], set()
    for k in range(200):
        texts.append(" ".join([*(word() for _ in range(11 + k % 5)), passage]))
        if k % 10 == 0:
            want.add(len(texts))
            texts.append(texts[-1].replace(passage, passage[:60] + "x" + passage[62:]))
    asked = []

    def counted(members, confirm, *others):
        def count(pairs):
            asked.append((pairs.count(), members.count()))
            return confirm(pairs)

        return bucket_links(members, count, *others)

    bucket_links = components.bucket_links
    monkeypatch.setattr(lines, "bucket_links", counted)
    got = {r["doc_id"] for r in lines.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
    assert asked and all(pairs <= rows for pairs, rows in asked)


def test_short_repeated_lines(spark):
    rows = [(1, "Of, edti oner.\n--\nAll rights reserved.\nmore"), (2, "Of, edti oner.\n--\n(All rights reserved)\nOf"), (3, "of\n\n--")]
    got = {r["doc_id"]: r["dropped"] for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [0, 2], 3: [0]}


def test_buckets_of_medium_size(spark):
    """Few near pairs are returned as they are, so no later step has rows for all lines of the bucket; many make it a crowd."""
    rng = np.random.default_rng(6)
    sparse = [(1, i, int(s)) for i, s in enumerate(rng.integers(0, 1 << 40, 200))] + [(1, 500, 7), (1, 501, 7), (1, 502, 6)]
    dense = [(2, 1000 + i, 5) for i in range(200)]
    near = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= 1
    for size in (10000, 37):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            found = components.pairs_in_buckets(spark.createDataFrame(sparse + dense, "bucket long, id long, sig long"), near, 256).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["head"], r["id"], r["first"]) for r in found if not r["big"]) == [(500, 501, True), (500, 502, True), (501, 502, False)]
        assert sorted(r["id"] for r in found if r["big"]) == [i for _, i, _ in dense] and {r["head"] for r in found if r["big"]} == {1000}


def test_unlike_pairs_are_let_go(monkeypatch):
    """Pairs in groups that shrink on the way, single ones, and how many of a group's columns unlike pairs take."""
    rng = np.random.default_rng(7)
    text = lambda n: "".join(rng.choice(list("abcd "), n))
    xs, ys, want = [], [], []
    for k in range(240):
        n = 380 + k % 40
        x = text(n)
        y = text(n) if k % 3 else x[:100] + "z" * (k % 60) + x[100:]
        xs.append(x)
        ys.append(y)
        want.append(k % 3 == 0 and k % 60 <= int(0.1 * len(y)))
    most = (np.array([max(len(x), len(y)) for x, y in zip(xs, ys, strict=True)]) * 0.1).astype(int)
    monkeypatch.setattr(edit_search, "word_by_word", lambda *some: False)
    for few in (0, edit_search.FEW):
        monkeypatch.setattr(edit_search, "FEW", few)
        assert edit_search.within(xs, ys, most).tolist() == want
    # A few pairs are no group.
    monkeypatch.setattr(edit_search, "group_within", None)
    assert edit_search.within(xs[:6], ys[:6], most[:6]).tolist() == want[:6]


def test_only_lines_that_others_meet_are_kept(spark, monkeypatch):
    """Lines that are there once and meet no other are in no table but the first, and groups are looked for once."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(3, 9)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(100)]
    texts += [texts[0], texts[1], texts[2] + " more"]
    sizes, calls = {}, []

    def stored(df, name, *others, **options):
        out = store.stored(df, name, *others, **options)
        sizes[name] = out.count()
        return out

    def components_of(links):
        calls.append(links)
        return components.components(links)

    monkeypatch.setattr(lines, "stored", stored)
    monkeypatch.setattr(lines, "components", components_of)
    got = {r["doc_id"] for r in lines.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {100, 101, 102}
    assert sizes["lines"] == 103 and sizes["distinct-lines"] <= 8 and len(calls) == 1


def test_buckets_sorted_by_one_key(spark):
    """Without least the same pairs are found and the same buckets are large, from rows that are sorted by the bucket alone."""
    rng = np.random.default_rng(11)
    bucket = np.concatenate((rng.integers(0, 60, 300), np.full(90, 70), np.full(300, 71)))
    rows = [(int(b), i, int(s)) for i, (b, s) in enumerate(zip(bucket, rng.integers(0, 1 << 9, len(bucket)), strict=True))]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    members = spark.createDataFrame(rows + rows[:50], "bucket long, id long, sig long")
    near = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= 1
    plan = components.pairs_in_buckets(members, near, 256, least=False)._jdf.queryExecution().toString()
    assert re.search(r"Sort \[bucket#\d+L ASC NULLS FIRST\], false", plan)
    found = []
    for least in (True, False):
        for size in (10000, 37):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            try:
                out = components.pairs_in_buckets(members, near, 256, least=least).collect()
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            large = [r for r in out if r["big"]]
            heads = {r["bucket"]: r["head"] for r in large}
            assert all(r["head"] == heads[r["bucket"]] for r in large) and {(r["bucket"], r["head"]) for r in large} <= {(r["bucket"], r["id"]) for r in large}
            found.append((sorted((r["bucket"], r["head"], r["id"], r["first"]) for r in out if not r["big"]), {(r["bucket"], r["id"], r["sig"]) for r in large}))
    assert all(x == found[0] for x in found) and found[0][0] and {b for b, *_ in found[0][1]} == {71}


def test_keys_of_both_grams_are_one_list():
    texts = ["x" * 3, "of lines some are short", "of lines others are longer than short ones, but not too long", "and this one is so long that grams of eight bytes alone are taken for its keys, as they are for most"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = lines.Lines(data, np.cumsum([0, *map(len, texts)]))
    got = lines.block_keys(found, found.hashes(), lines.EDIT_SIMILARITY)
    keys, sig, short_sig = (got[c].to_pylist() for c in ("keys", "sig", "short_sig"))
    assert [x and len(x) for x in keys] == [None, lines.BANDS, 2 * lines.BANDS, lines.BANDS]
    assert [x is None for x in sig] == [True, False, False, False] and [x is None for x in short_sig] == [True, True, False, True]
    assert sig[2] != short_sig[2] and len(set(keys[2])) == 2 * lines.BANDS
