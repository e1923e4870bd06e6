"""The registered queries on small tables with odd rows, against plain versions of what they should give."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from furlong.llm import decontaminate, lines, minhash, packing, quality, queries, tokens, toxicity
from furlong.llm.edits import within
from furlong.llm.store import load

from test_operators import groups_of

RNG = np.random.default_rng(11)
VOCABULARY = ["".join(RNG.choice(list("etaoinshrdlucm"), RNG.integers(2, 9))) for _ in range(600)]
ITEMS = [(k, " ".join(RNG.choice(VOCABULARY, 18)).capitalize() + "? " + " ".join(RNG.choice(VOCABULARY, 9)) + ".") for k in range(30)] + [(30, None), (31, "..."), (32, "")]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n)) + "."


LONG = " ".join(np.random.default_rng(1).choice(VOCABULARY, 60_000))
TEXTS = [
    (1, prose(120, 1) + "\n" + prose(30, 2)), (2, prose(120, 1) + "\n" + prose(30, 2)), (3, prose(120, 1) + "\n" + prose(30, 2) + " more words"), (4, None), (5, ""), (6, "one two"), (6, "one two"), (7, prose(40, 3)), (7, prose(50, 4)),
    (8, prose(40, 3)), (None, prose(40, 3)), (None, prose(60, 5)), (9, "x" * 300), (10, " \n\n \t "), (11, "ab " * 300), (12, prose(200, 6) + " " + ITEMS[3][1].upper() + " " + prose(80, 7)), (13, ITEMS[5][1]), (14, LONG), (15, LONG[:5000] + "\n" + LONG[7000:9000]),
    (16, "Été à Lyon, où l'on dîne ? " * 9 + "<|endoftext|>"), (17, "\n".join([prose(25, 8)] * 3 + [prose(25, 8).replace("e", "E", 3) + "!"])), (18, "#*$ " * 20 + prose(30, 9)), (19, ITEMS[7][1][:60]),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, mark long, `doc id` string, id long, n_lines long, n_dropped long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 7, "d", 3, 99, 98) for i, t in TEXTS], COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id long, text string, doc_id long").write.parquet(f"{at}/benchmark.parquet")
    pages = [(k, f"http://h{k % 3}.example.org/p{k % 5}?q={k % 2}#f", f"<html><body><nav>menu</nav><article><p>Page {k % 4} has a text, long enough to count as one, é.</p></article></body></html>") for k in range(40)]
    pages += [(40, None, None), (41, "", ""), (41, "http://h1.example.org/p1", "again"), (None, "http://h1.example.org/p1", "again"), (42, "no url", "<p>" + "long text, " * 40_000)]
    spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, surt string").repartition(3).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, 1, int(i in (7, 9))) for i in range(1, 19)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def plain_ids(text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records(spark, folder):
    got = sorted(rows(spark, folder, "op2_token_records"), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist() == [r["start"] for r in got]
    want = [(i, plain_ids(t, 2)) for i, t in TEXTS]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)


def test_pieces(spark, folder):
    want = Counter()
    for i, t in TEXTS:
        ids, start = plain_ids(t, 1), 0
        while start < len(ids):
            left = len(ids) - start
            size = 2048 if left >= 2048 else 1 << left.bit_length() - 1
            want[i, start, size, crc(ids[start : start + size]), len(ids)] += 1
            start += size
    got = rows(spark, folder, "op9_packing")
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] for r in got)
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch"], set()).add(r["length"])
    assert all(len(x) == 1 for x in sizes.values())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(spark, folder):
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    want = Counter()
    for i, t in TEXTS:
        w, t = words(t), t or ""
        places = {}
        for k in range(len(w) - 7):
            places.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeats = len({k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)})
        seen, again = set(), 0
        for line in t.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        failed = len(w) < 20 or 100 * repeats > 30 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, repeats, failed, not failed and quality.ratio_verdict(compress, t.encode())[2]] += 1
    got = rows(spark, folder, "op7_quality")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == want


def test_archives(spark, folder):
    pages = load(spark, folder, "pages").collect()
    last = {}
    for p in pages:
        last[p["html"] or ""] = max(last.get(p["html"] or "", -1), -1 if p["page_id"] is None else p["page_id"])
    want = Counter()
    for p in pages:
        body, first = (p["html"] or "").encode(), last[p["html"] or ""]
        own = p["page_id"] == first
        want[p["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first] += 1
    got = rows(spark, folder, "op4_warc")
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_main_text(spark, folder):
    got = {r["page_id"]: r for r in rows(spark, folder, "op6_html_text") if r["page_id"] is not None and r["page_id"] != 41}
    assert all(got[k]["text"] == f"Page {k % 4} has a text, long enough to count as one, é." for k in range(40)) and got[40]["text"] == ""
    assert got[42]["n_chars"] == len(got[42]["text"]) == len("long text, " * 40_000) - 1


def test_near_duplicates_and_one_of_each(spark, folder):
    sets = []
    for i, t in TEXTS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    some = [k for k, (i, _) in enumerate(TEXTS) if i is not None]
    comp = {k: TEXTS[k][0] for k in some}
    linked = [(a, b) for a in some for b in some if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in some:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = rows(spark, folder, "op3_minhash")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((TEXTS[k][0], len(sets[k]), comp[k], comp[k] == TEXTS[k][0]) for k in some)
    # A row of each group stays; rows without a word or an id all do.
    docs = load(spark, folder, "documents")
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns
    group = list(comp)
    for _ in some:
        for a, b in linked:
            group[some.index(a)] = group[some.index(b)] = min(group[some.index(a)], group[some.index(b)])
    want = len({group[some.index(k)] for k in some if sets[k]}) + sum(not sets[k] for k in some) + sum(i is None for i, _ in TEXTS)
    assert left.count() == want and {(r["doc_id"], r["text"]) for r in left.collect()} >= {(1, TEXTS[0][1]), (7, prose(40, 3)), (7, prose(50, 4)), (None, prose(60, 5)), (4, None)}


def test_bm25(spark, folder):
    """Every passage and item, term by term."""
    from furlong.llm.decontaminate import B, GRAM, K1, OVERLAP, THRESHOLD

    split = lambda t: re.findall(r"[a-z0-9à-ÿ]+", (t or "").lower())
    items = {k: split(t) for k, t in ITEMS if split(t)}
    df = Counter(w for x in items.values() for w in set(x))
    mean = sum(map(len, items.values())) / len(items)
    stride = max(decontaminate.LEAST_PASSAGE, max(map(len, items.values())))
    runs = lambda x, n: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    want = {}
    for i, t in TEXTS:
        w = split(t)
        n = math.ceil(len(w) / stride)
        for p in range(max(1, n - 1)) if n else ():
            passage = w[p * stride : (p + 2) * stride]
            have = set(passage)
            for k, x in items.items():
                tf = Counter(x)
                share = {a: math.log1p((len(items) - df[a] + 0.5) / (df[a] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for a, c in tf.items()}
                score = sum(s for a, s in share.items() if a in have) / sum(share.values())
                halves = [split(h) for h in decontaminate.question_answer(dict(ITEMS)[k])]
                sizes = [min(GRAM, max(1, len(h) // 2)) for h in halves]
                overlap = [len(runs(h, n) & runs(passage, n)) / len(runs(h, n)) if runs(h, n) else 1.0 for h, n in zip(halves, sizes, strict=True)]
                if score >= THRESHOLD and min(overlap) >= OVERLAP:
                    count, best = want.get((i, k), (0, 0.0))
                    want[i, k] = (count + 1, max(best, score))
    got = {(r["doc_id"], r["item_id"]): (r["passages"], r["score"]) for r in rows(spark, folder, "op8_decontaminate")}
    assert {(12, 3), (13, 5)} <= set(want) and got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    # The parts that a large set of items is cut to change nothing.
    docs, items = load(spark, folder, "documents"), load(spark, folder, "benchmark")
    parts = decontaminate.contaminated(docs, items, limit=2000)
    assert {(r["doc_id"], r["item_id"]): (r["passages"], round(r["score"], 9)) for r in parts.collect()} == {k: (c, round(s, 9)) for k, (c, s) in got.items()}
    assert decontaminate.keep_clean(docs, items, limit=2000).count() == len(TEXTS) - sum(i in {d for d, _ in want} for i, _ in TEXTS)


def test_scores_are_noisy_or_of_sentences(spark, folder):
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    model = toxicity.Model({"one": 9.0, VOCABULARY[3]: 2.0, VOCABULARY[5][:4] + "-": 4.0, VOCABULARY[8]: 8.5}, -8.0)
    got = Counter()
    for r in toxicity.score(docs, model).collect():
        got[r["doc_id"], round(r["score"], 9), r["predicted"], len(r["sentences"]) > 0] += 1
    want = Counter()
    for i, t in TEXTS:
        quiet = 1.0
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", (t or "").lower()) if s] or [""]
        for s in sentences:
            z = model.bias + sum(w for f, w in model.weights.items() if f in toxicity.features(s))
            quiet *= 1 - 1 / (1 + math.exp(-z))
        want[i, round(1 - quiet, 9), int(1 - quiet >= 0.5), 1 - quiet >= 0.5] += 1
    assert got == want and any(k[2] for k in want)
    found = rows(spark, folder, "op1_toxicity")
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(TEXTS)


def test_lines(spark, folder):
    """Groups of lines by brute force; long lines are taken once, as each is near itself alone."""
    keys = sorted({(i, t) for i, t in TEXTS if i is not None and t}, key=lambda x: (x[0], spark.range(1).select(F.xxhash64(F.lit(x[1]))).first()[0]))
    all_lines = [(i, t, k, lines.normalise(x)) for i, t in keys for k, x in enumerate(t.split("\n")) if lines.normalise(x)]
    distinct = list(dict.fromkeys(x for *_, x in all_lines))
    short = [x for x in distinct if len(x) < 5000]
    group = dict(zip(short, groups_of(short), strict=True)) | {x: x for x in distinct if len(x) >= 5000}
    seen, want = set(), {}
    for i, t, k, x in all_lines:
        if group[x] in seen:
            want.setdefault((i, t), set()).add(k)
        seen.add(group[x])
    expected = Counter()
    for i, t in TEXTS:
        gone = want.get((i, t), set())
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        if not gone or words(left):
            expected[i, t if t is None else left, len(gone)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in rows(spark, folder, "op5_line_dedup")) == expected
    docs = load(spark, folder, "documents")
    left = lines.dedup_lines(docs, counts=False, length_col="n_chars")
    assert left.columns == docs.columns and all(r["n_lines"] == 99 and r["n_chars"] == len(r["text"] or "") for r in left.collect())


def test_recall_of_near_lines(spark):
    """Against all pairs of lines of the smallest tables; what is found is never wrong."""
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    occurrences = [(r["doc_id"], k, line) for r in docs.orderBy("doc_id").collect() for k, x in enumerate((r["text"] or "").split("\n")) if (line := lines.normalise(x))]
    distinct = sorted(dict.fromkeys(x for *_, x in occurrences), key=len)
    size = np.array([len(x) for x in distinct])
    letters = np.array([[x.count(c) for c in "abcdefghijklmnopqrstuvwxyz 0"] for x in distinct])
    component = list(range(len(distinct)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i in range(len(distinct)):
        j = np.arange(i + 1, np.searchsorted(size, int(size[i] / 0.9) + 1, "right"))
        most = (size[j] * 0.1 + 1e-9).astype(int)
        # An edit changes two counts of letters by one at most.
        near = np.abs(letters[j] - letters[i]).sum(axis=1) <= 2 * most
        j, most = j[near], most[near]
        if len(j):
            for k in j[within([distinct[i]] * len(j), [distinct[k] for k in j], most)]:
                a, b = sorted((root(i), root(int(k))))
                component[b] = a
    place = {x: i for i, x in enumerate(distinct)}
    seen, near_seen, equal, want = set(), set(), set(), set()
    for i, k, x in occurrences:
        if root(place[x]) in near_seen:
            want.add((i, k))
        if x in seen:
            equal.add((i, k))
        seen.add(x)
        near_seen.add(root(place[x]))
    got = {(r["doc_id"], k) for r in lines.repeated_lines(docs).collect() for k in r["dropped"]}
    assert equal <= got <= want and len(want - equal) >= 20 and len(got - equal) >= 0.9 * len(want - equal)


def test_stages_keep_columns_and_rows(spark, folder):
    docs = load(spark, folder, "documents")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, empty, folder).count() == 0, name
    packed = corpus_pipeline.run(spark, folder)
    kept = {r["doc_id"] for r in packed.collect()}
    # The copies, the short, the repetitive and the contaminated go; the others stay.
    assert {1, 7, 14} <= kept and not kept & {2, 4, 5, 6, 9, 10, 11, 12, 13}
    assert packing.pack(empty, tokens.vocabulary()).count() == 0
