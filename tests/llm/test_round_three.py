"""Conversation repair, positive-unlabelled quality and spelling variants, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from furlong.llm import conversations as C
from furlong.llm import positive_unlabelled as P
from furlong.llm import queries
from furlong.llm import variants as V

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ALTERNATE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def plain_repair(rows):
    """Cheapest edits of rows (conv_id, turn, role, text), by all states with their least (cost, letters)."""
    by_key = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mine = by_key.setdefault(conv, [])
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if rule:
            row = (turn, "user" if rule == 4 else role, "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text)
            mine += [row] * (2 if rule == 3 else 1)
    out = []
    for conv, mine in by_key.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in mine:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in mine if t is not None]
        # State: initial of the last turn; value: cost, letters, lines.
        best = {"": (0, "", ())}

        def inserted(states):
            for _ in range(2):
                for q, (cost, letters, lines) in list(states.items()):
                    role = ALTERNATE[q]
                    new = (cost + 5, letters + "I", (*lines, role + ":"))
                    if role[0] not in states or new < states[role[0]]:
                        states[role[0]] = new
            return states

        best = inserted(best)
        for (_, role, text), kind in zip(mine, kinds):
            nxt = {}
            for q, (cost, letters, lines) in best.items():
                late = 5 * (kind == "truncated")
                ways = [(cost + 2, letters + "D", lines, q)]
                if kind not in ("blank", "duplicate"):
                    fits = role[:1] == "s" and q == "" or role[:1] == "u" and q != "u" or role[:1] == "a" and q == "u"
                    if fits:
                        ways.append((cost + late, letters + "K", (*lines, f"{role}:{text}"), role[0]))
                    ways.append((cost + 1 + late, letters + "R", (*lines, f"{ALTERNATE[q]}:{text}"), ALTERNATE[q][0]))
                for c, a, t, to in ways:
                    if to not in nxt or (c, a) < nxt[to][:2]:
                        nxt[to] = (c, a, t)
            best = inserted(nxt)
        cost, letters, lines = min(best[q] for q in ("", "a") if q in best)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = Counter(kinds)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_conversations():
    rng = random.Random(3)
    texts = ["Yes.", "No", "Well!\n ", " \t", "", None, "Été ? ", "a b", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts)))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    # A long one, one that is all copies, one whose only row is dropped.
    rows += [(100, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"turn {t % 300}.") for t in range(700)]
    rows += [(101, 1, "user", "again.")] * 40 + [(102, None, "user", "gone.")] * 3
    dropped = next(i for i in range(200, 400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "one.")]


@pytest.mark.parametrize("held", [C.HELD, 600])
def test_conversations_equal_a_plain_version(spark, held):
    rows = odd_conversations()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, cost string").repartition(5)
    got = C.repair(table, damaged=True, held=held)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_repair(rows)
    # The repaired turns themselves, which the digest is of.
    by_key = {}
    for r in C.repair(table, damaged=True, turns=True, held=held).orderBy("conv_id", "place").collect():
        by_key.setdefault(r["conv_id"], []).append(r)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in got.collect()}
    for key, digest in digests.items():
        turns = by_key.get(key, [])
        assert [r["place"] for r in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == digest
    assert C.repair(table.limit(0)).collect() == []


def test_conversations_equal_their_sql(spark, tmp_path):
    rows = odd_conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet' where conv_id <> 100 or conv_id is null")
    assert [r for r in got if r[0] != 100] == sorted(db.execute(queries.ORACLES["op11_conversation_repair"]).fetchall(), key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_blocks_of_any_length_give_the_same_edits(block):
    rng = random.Random(block)
    tables, one = C.Tables(block), C.Tables(1)
    for _ in range(400):
        symbols = np.array([rng.randrange(C.SYMBOLS) for _ in range(rng.randrange(12))], np.int64)
        assert tables.edits(symbols) == one.edits(symbols)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    lists = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, found in lists.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(lists[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def odd_words():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé×") for _ in range(rng.randrange(7, 10))) for _ in range(120)]
    docs = [(None, "Grandiose grandiose GRANDIOSE-grandios"), (1, None), (2, ""), (2, "twotwotwo " * 3), (2, "twotwotwo " * 3), (3, "É" * 900 + " " + "É" * 900 + "x" + " " + "É" * 900 + " y" + "É" * 900 + "x")]
    # Each word common, with rarer variants of it, and still rarer ones of those.
    for w in words:
        docs.append((rng.randrange(10**6), f"{w} " * 2))
    chain = ["abcabcabc", "abcabcabd", "abcabcaad", "abcabbaad"]
    docs += [(i, f"{w}, " * (4 * 12**k)) for i, (k, w) in enumerate(zip((3, 2, 1, 0), chain), 50)]
    docs += [(8, " ".join(f"common{x}word " * 2 for x in "abcdefg"))]
    # Many words of the same letters.
    docs += [(9, " ".join("".join(rng.sample("aabbccdd", 8)) for _ in range(500)))] * 2
    docs += [(10, " ".join(rng.choice(["aabbccd", "aabbccdde", "abbccdda", "aabccdde"]) for _ in range(60)))]
    return docs


@pytest.mark.parametrize("cell", [V.CELL, 40])
def test_variants_equal_all_pairs(spark, tmp_path, cell):
    docs = odd_words()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = V.variants(table, cell=cell)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == plain_variants(docs)
    assert any(r[1] and r[2] != r[1] for r in rows) and max(r[4] for r in rows) > 3
    if cell == V.CELL:
        table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
        db = duckdb.connect()
        db.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
        assert rows == sorted(db.execute(queries.ORACLES["op13_spelling_variants"]).fetchall(), key=repr)
        assert V.variants(table.limit(0)).collect() == []


def test_upper_trees_part_even_one_vector():
    """Words of the same letters are dealt by a hash, and searched only where their candidates lie."""
    rng = random.Random(2)
    points = sorted({bytes(rng.sample(b"aabbccdde", 9)) for _ in range(600)} | {bytes(rng.choice(b"abcdef") for _ in range(9)) for _ in range(50)})
    asked = sorted({bytes(rng.sample(b"aabbccddf", 9)) for _ in range(300)} | {bytes(rng.sample(b"aabbccddee", 10)) for _ in range(300)})
    dealer = V.Dealer({9: V.grow(V.letter_counts(V.letters_of(points)), 50)})
    cells = {}
    for leaf, part, members in dealer.cells(points, 9, False):
        cells.setdefault((leaf, part), ([], []))[0].extend(points[i] for i in members)
    assert sum(len(p) for p, _ in cells.values()) == len(points) and max(len(p) for p, _ in cells.values()) < 150
    found = Counter()
    for length in (9, 10):
        mine = [w for w in asked if len(w) == length]
        for leaf, part, members in dealer.cells(mine, 9, True):
            for w in (mine[i] for i in members):
                found.update((w, p) for p in cells.get((leaf, part), ([], []))[0] if near(w.decode(), p.decode()))
    assert found == Counter((w, p) for w in asked for p in points if near(w.decode(), p.decode()))


def test_positive_unlabelled_quality(spark):
    """Held-out accuracy on the test tables, where no negative label is used."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_pu_quality"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(got) == sorted(r["doc_id"] for r in docs)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for k, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [r["score"] for r, q in held if q], [r["score"] for r, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.5


def test_quality_of_odd_rows(spark):
    text = "Words of plain prose stand here, and more of them follow. "
    rows = [(i, text * (i % 5 + 1) if i % 6 else "BUY!! NOW!! " * 9) for i in range(60)] + [(None, text), (61, None), (62, ""), (63, "x" * 100_000), (5, text)]
    docs = spark.createDataFrame([(*r, 3.0, 1) for r in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60) if i % 6] + [(None, 1, 0), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = P.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] is None for r in got) == 1
    assert {r["score"] for r in P.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert P.quality_scores(docs.limit(0), labels).collect() == []


def test_prior_and_calibration():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 600)
    web = np.concatenate((rng.normal(2, 1, 2400), bad))
    prior = P.mixture_share(good, web)
    assert abs(prior - 0.8) < 0.05
    slope, shift = P.calibrate(good, web, 0.8)
    chance = P.sigmoid(slope * web + shift)
    assert slope > 0 and abs(chance.mean() - 0.8) < 0.02 and chance[-600:].mean() < 0.2 < 0.8 < chance[:2400].mean()


def story(rng, k):
    """A paragraph of an article."""
    return f"Part {k} says, {' '.join(rng.choice(['more', 'less', 'and', 'so', 'on', 'again', 'then']) for _ in range(rng.randrange(8, 40)))}."


def generated_page(rng):
    """A page, and the text of its article by construction: nested and sibling containers, link lists, listed names, and things around it."""
    text, k = [], iter(range(10**6))

    def paragraphs(n):
        made = [story(rng, next(k)) for _ in range(n)]
        text.extend(made)
        return "".join(f"<p>{x}</p>" for x in made)

    def around():
        words = " ".join(f"Noise {rng.randrange(100)} of theirs, and of ours." for _ in range(rng.randrange(1, 12)))
        return rng.choice([
            f"<div class='{rng.choice(['ad', 'comments', 'comment-list', 'cookie-notice', 'sidebar right', 'share-buttons', 'newsletter box'])}'><p>{words}</p></div>", f"<aside><p>{words}</p></aside>", f"<form>{words}<input></form>", f"<script>var x = '<p>{words}</p>';</script>",
            "<div class='related-articles'><ul>" + "".join(f"<li><a href=/{i}>Other {i}</a></li>" for i in range(6)) + "</ul></div>", f"<nav><ul><li><a href=/>{words}</a></li></ul></nav>", "<ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(5)) + "</ul>", "<!-- <p>none of it</p> -->",
        ])

    def container(depth):
        kind = rng.randrange(6)
        if depth == 0 or kind == 0:
            return paragraphs(rng.randrange(1, 4))
        if kind == 1:
            lead = paragraphs(2)
            made = [f"See what number {next(k)} had to say to them." for _ in range(rng.randrange(2, 5))]
            text.extend(made)
            return lead + "<ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(made)) + "</ul>"
        name = rng.choice(["", "", " class='content'", " class='related-work'", " class=notice-of-results", " id=part"])
        tag = rng.choice(["div", "section"])
        many = 3 if "class" in name and "content" not in name else rng.randrange(1, 4)
        inside = "".join(container(depth - 1) if i or "-" not in name else paragraphs(4) for i in range(many))
        return f"<{tag}{name}>{inside}</{tag}>" + (around() if rng.random() < 0.3 else "")

    whole = rng.choice(["article", "main", "div"])
    first = story(rng, next(k))
    text.append(first)
    body = f"<p>{first}</p>" + paragraphs(2) + "".join(container(2) for _ in range(rng.randrange(1, 5)))
    if whole == "div" and rng.random() < 0.5:
        # No container of its own: parts lie side by side in the page.
        text.clear()
        body = "".join(f"<div>{paragraphs(2)}</div>" + (around() if rng.random() < 0.5 else "") for _ in range(rng.randrange(2, 6)))
        return f"<html><head><title>t</title></head><body>{around()}{body}<footer><p>They own all of this.</p></footer></body></html>", "\n".join(text)
    return f"<html><head><title>t</title></head><body>{around()}<{whole}>{body}</{whole}>{around()}<footer><p>They own all of this.</p></footer></body></html>", "\n".join(text)


def test_generated_pages_keep_their_article(spark, tmp_path):
    rng = random.Random(12)
    made = [generated_page(rng) for _ in range(400)]
    spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, (h, _) in enumerate(made)], "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.QUERIES["op6_html_text"](spark, str(tmp_path)).collect()}
    assert [got[i]["text"] for i in range(len(made))] == [t for _, t in made]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.QUERIES["op6_html_text"](spark, f"{tmp_path}/none").collect() == []


def test_long_and_wide_pages_take_time_in_proportion():
    import time

    from furlong.llm.html_text import main_text

    wide = "<div>" + "".join(f"<p>Line {i} of a very long page, with words.</p><div class='related-work'>x</div>" for i in range(40_000)) + "</div>"
    began = time.time()
    assert main_text(wide).count("\n") == 39_999 and time.time() - began < 30
    same = "<p>Equal parts, of equal worth, stand here.</p>"
    assert main_text(f"<div>{same}</div><div>{same}</div>").count("\n") == 1


def test_urls_of_one_key_are_told_apart(spark, tmp_path):
    from furlong.llm import warc

    urls = ["http://a.org/x", "https://a.org/x", "http://a.org:8080/x", "HTTP://A.org/x#part", "http://a.org/X", "", None, "a.org/x"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    shards = warc.write_archives(pages, f"file://{tmp_path}/archives")
    find = lambda *asked: sorted(r["page_id"] for r in warc.lookup(shards, spark.createDataFrame([(u,) for u in asked], "url string")).collect())
    assert find("http://a.org/x") == find("http://A.ORG/x#other", "http://a.org/x") == [0, 3]
    assert find("https://a.org/x") == [1] and find("http://a.org:8080/x") == [2] and find("http://a.org/X", "nothing") == [4] and find("a.org/x") == [7]
    assert sorted(r["page_id"] for r in warc.archived(pages).collect()) == list(range(len(urls)))


def test_archives_of_many_shards(spark, monkeypatch):
    from furlong.llm import store, warc

    monkeypatch.setattr(store, "FAN", 5)
    urls = [f"http://h{i % 40}.org/{i}" for i in range(200)] + ["http://same.org/x"] * 40
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = store.new_path(spark, "many")
    shards = warc.write_archives(pages, path, shards=80)
    depth, root = warc.upper_levels(shards, store.new_path(spark, "tree"))
    assert depth >= 2 and len(root) <= 5 and shards.count() > 25
    found = warc.lookup(shards, spark.createDataFrame([(u,) for u in [*urls, "http://none.org/", "http://h1.org/"]], "url string"))
    assert sorted((r["page_id"], r["url"]) for r in found.collect()) == list(enumerate(urls))
    flat = sorted((r["shard"], r["first"]) for r in shards.collect())
    children = warc.read_node
    for key in {f for _, f in flat} | {"", "org,h1", "zz"}:
        names = [i for i, _ in warc.shards_of(key, root, depth, children)]
        before = [i for i, f in flat if f < key]
        assert names == before[-1:] + [i for i, f in flat if f == key]
    none = warc.write_archives(pages.limit(0), store.new_path(spark, "none"))
    assert warc.upper_levels(none, path) == (0, []) and warc.lookup(none, pages.select("url")).count() == 0


def test_running_sums_have_levels(spark, monkeypatch):
    from furlong.llm import records, store, tokens

    monkeypatch.setattr(store, "FAN", 4)
    rng = random.Random(8)
    rows = [(i, rng.randrange(9)) for i in range(150) if rng.random() < 0.8]
    got = store.running_before(spark.createDataFrame(rows, "shard int, n long"), "shard", "n", "before")
    assert {r["shard"]: r["before"] for r in got.collect()} == {i: sum(n for j, n in rows if j < i) for i, _ in rows}
    assert got.columns == ["shard", "n", "before"] and store.running_before(got.limit(0).drop("before"), "shard", "n", "before").count() == 0
    docs = spark.createDataFrame([(i, "word " * rng.randrange(9)) for i in range(120)], "doc_id long, text string")
    read = records.read_records(records.write_records(docs, store.new_path(spark, "t"), tokens.vocabulary(), shards=30)).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(read):
        assert (r["doc_id"], r["start"], len(r["ids"])) == (i, at, r["n_tokens"])
        at += r["n_tokens"]
