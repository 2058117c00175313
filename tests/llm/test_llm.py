"""The operators of quarry.llm on small inputs: against brute force, exact round trips and held-out labels."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, html, linededup, media, mixing, neardup, quality, sentencepiece, sharding, toxicity
from quarry.llm.shared import components, packed_matches

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that clash."""
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    rows = [(1, None, None, None, None), (None, "no id here at all", "en", "a", 3), (2, "", "en", None, 0), (3, "   \n\t", "EN", "b", 5), (4, long, "xx1", "a", 9), (5, "tie line\ntie line\n\nend", "de", "a", 1), (5, "tie line\ntie line\n\nend", "de", "a", 1), (6, "a b", "de", "", 3)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("u", "root", "size", "kept", "bucket", "y", "k", "ids", "_id", "h"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_packed_matches(spark):
    a, b = 0x1234567890ABCDE, 0x1034567890ABCD0
    one = spark.createDataFrame([(a, b)], "a long, b long")
    assert one.select(packed_matches([F.col("a")], [F.col("b")])).first()[0] == 6


def test_quality_base_rules(spark, docs):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = words(text)
        seen, hit = {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {i + k for i in at for k in range(3)}
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        r = got[doc_id]
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_kneser_ney_model_sums_to_one():
    rng = np.random.default_rng(1)
    keys = rng.choice(quality.SYMBOLS**3, 500, replace=False)
    keys.sort()
    model = quality.estimate(keys, rng.integers(1, 9, 500))
    for ctx in (int(keys[0]) // quality.SYMBOLS, int(keys[77]) // quality.SYMBOLS, 5):
        p = np.exp(quality.look_up(model, ctx * quality.SYMBOLS + np.arange(quality.SYMBOLS)))
        assert p.sum() == pytest.approx(1.0, abs=1e-9)


def test_quality_passes_give_the_same_result(docs):
    a = quality.quality(docs).select("doc_id", "kept", "log_ppl").orderBy("doc_id").collect()
    b = quality.quality(docs.repartition(7), pass_bytes=1).select("doc_id", "kept", "log_ppl").orderBy("doc_id").collect()
    assert [(r[0], r[1], r[2] and round(r[2], 9)) for r in a] == [(r[0], r[1], r[2] and round(r[2], 9)) for r in b]


def test_quality_judges_small_languages(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("bdklmnrst") + rng.choice("aeio") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(200)), ("en", "en-US", "en_GB")[i % 3], "s", 1) for i in range(40)]
    rows += [(100, " ".join("".join(rng.choice("qxzjvwyhgfcp") for _ in range(5)) for _ in range(60)), "EN", "s", 1)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert {r["lang"] for r in got.values()} == {"en"}
    assert not got[100]["base_failed"] and not got[100]["kept"]
    assert all(got[i]["kept"] for i in range(40))


def test_near_duplicates_match_brute_force(spark, docs):
    base = [f"w{i}" for i in range(120)]
    extra = []
    rng = random.Random(5)
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = f"x{k}{rng.randrange(99)}"
        extra.append((100_000 + k, " ".join(w), "en", "s", 1))
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, DOCS))
    sets = {}
    for i, t in both.select("doc_id", "text").collect():
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(both, words=4).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_superminhash_estimates_and_early_stop():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:3000])
    sig = neardup.superminhash(np.concatenate([a, b, a]), np.array([2000, 2000, 2000]), 128)
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.15
    few = neardup.superminhash(pool[:3], np.array([3, 0]), 64)
    assert (few[0] != neardup.UNSET).all() and (few[1] == neardup.UNSET).all()


def test_sharding_is_a_reproducible_permutation(docs):
    a = sharding.shard(docs, 16).collect()
    per = {}
    for r in a:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in a)
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, sharding.shard(docs.repartition(5), 16).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 99, 1000])
def test_permutation_of_any_size(spark, n):
    side = int(np.ceil(np.sqrt(n)))
    p = spark.range(n).select(sharding.permute(F.col("id"), F.lit(n), F.lit(side)).alias("p"))
    assert sorted(r["p"] for r in p.collect()) == list(range(n))


def test_html_wrappers():
    def page(n, extra=""):
        return f'<html><head><title>x</title></head><body><header>Site</header><ul class="menu"><li>Home<li>Away</ul><div class="col"><h1>Title {n}</h1><p>First &amp; <b>bold</b>\n text {n}<p>Second {n}{extra}<p class="share">Share this</div><div id="comments"><p>Comment {n}</p></div><footer>Foot</footer></body></html>'

    wrapper = html.pack(html.infer([html.fold(html.parse(page(n))) for n in range(6)]), 6)
    assert html.main_text(page(9), wrapper) == "Title 9\nFirst & bold text 9\nSecond 9"
    assert html.main_text(page(9, "<ul><li>one<li>two</ul>"), wrapper) == "Title 9\nFirst & bold text 9\nSecond 9\none\ntwo"
    assert html.main_text(None, wrapper) == html.main_text("", None) == ""
    assert html.main_text("<div>" * 5000 + "deep", None) == "deep"
    assert html.main_text('<article><p>a<script>var x="</p>"</script><p>b &lt;<!-- c --></article><aside>no</aside>', None) == "a\nb <"


def test_html_keeps_text_beside_the_largest_element(spark):
    def page(n, a, b):
        return f"<body><h1>Title {n}</h1><div class='a'><p>{f'first {n} ' * a}</div><div class='b'><p>{f'second {n} ' * b}</div><footer>Foot</footer></body>"

    rows = [(n, f"http://a/{n}", page(n, 65, 35) if n < 20 else page(n, 1, 99)) for n in range(24)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, _, _ in rows:
        a, b = (65, 35) if n < 20 else (1, 99)
        assert got[n] == "\n".join([f"Title {n}", (f"first {n} " * a).strip(), (f"second {n} " * b).strip()])


def test_html_query_reads_every_page(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<article><p>one</article>"), (1, "http://a/x", "<article><p>one</article>"), (2, None, None), (3, "::", "plain")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect())
    assert got == [(1, "one", 3), (1, "one", 3), (2, "", 0), (3, "plain", 5)]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(pages, broadcast_bytes=0).collect()) == got
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_html_drops_only_what_all_pages_share(spark):
    ids = spark.range(30).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), F.col("id").cast("string")).alias("url"))
    sampled = [r["page_id"] for r in ids.orderBy(F.xxhash64("url", "page_id"), "page_id").limit(8).collect()]
    rows, want = [], {}
    for i in range(30):
        kicker = "News" if i in sampled else f"Kicker {i}"
        rows.append((i, f"http://a/{i}", f"<body><div>Site name</div><section><h2>{kicker}</h2><h1>Title {i}</h1><p>Text {i} <p>More {i}</section></body>"))
        want[i] = f"{kicker}\nTitle {i}\nText {i}\nMore {i}"
        rows.append((100 + i, f"http://b/{i}", f"<body><section><h1>One article</h1><div>only paragraph</div></section><footer>{i}</footer></body>"))
        want[100 + i] = "One article\nonly paragraph"
        rows.append((200 + i, f"http://c/{i}", f"<article><h1>Same</h1><p>Text {i}</article>"))
        want[200 + i] = f"Same\nText {i}"
        rows.append((300 + i, f"http://d/{i}", f"<body><section><h4>All rights</h4><div>Text {i}</div></section></body>"))
        want[300 + i] = f"Text {i}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()} == want
    assert {r["page_id"]: r["text"] for r in html.extract_pages(pages, broadcast_bytes=0).collect()} == want


def test_html_wrappers_come_from_all_pages_of_a_host(spark):
    """Template text that only pages beyond the first eight of a host (by hash) have."""
    ids = spark.range(30).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), F.col("id").cast("string")).alias("url"))
    first = [r["page_id"] for r in ids.orderBy(F.xxhash64("url", "page_id"), "page_id").limit(8).collect()]
    rows = [(i, f"http://a/{i}", f"<body><section><h1>Title {i}</h1><p>Text {i}</section>{'' if i in first else '<div class=end><h4>All rights</h4></div>'}</body>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()} == {i: f"Title {i}\nText {i}" for i in range(30)}


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "ho"), (5, None, None, None), (None, 0, "user", "hi"), (6, 0, "user", "ho"), (6, 0, "user", "hoho")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("t", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["rendered"]) for r in chat.chat_format(c).collect()}
    assert got == {2: (2, 2, "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>"), 5: (1, 1, "<|unknown|>\n\n<|end|>"), 6: (2, 1, "<|user|>\nho\n<|end|>\n<|user|>\nhoho\n<|end|>")}
    assert chat.chat_format(c.limit(0)).count() == 0


def water_fill(sizes, weights, repeat=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > repeat * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = repeat * sizes[i]
        open_ -= over
    return target


def test_mixing_reaches_targets(spark, docs):
    few = docs.where("source <> 'src3' or doc_id % 5 = 0").withColumn("source", F.when(F.col("source") != "src9", F.col("source")))
    got = mixing.mix(few, block=64).collect()
    src = dict(few.select("doc_id", "source").collect())
    texts = dict(few.select("doc_id", "text").collect())
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = src[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert target[s] == pytest.approx(t)
        assert 0 <= t - taken[s] < 1 + 1e-6
    again = mixing.mix(few.repartition(3), block=64).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_schedule_ranks_slots(spark):
    s = spark.createDataFrame([("a", 0, 5, 1000, 700.0), ("b", 1, 2, 500, 900.0), ("c", 2, 1, 10, 30.0)], "source string, s int, weight long, source_size long, target double")
    rows = sorted((r["s"], r["slot"], r["rank"]) for r in mixing.schedule(s, 10).collect())
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        assert [r[2] for r in own] == list(range(len(own)))
    assert len({r[1] for r in rows}) == len(rows) == 70 + 90 + 3


def test_media_round_trip(spark, docs):
    for n in (0, 1, 576, 577, 5000, 100_000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        blob = media.write_container(media.pad(data))
        info = media.read_container(blob)
        back = media.read_payload(blob, info)
        assert back == media.pad(data) and len(back) % 576 == 0
        assert info["codec"] == "raw" and info["duration"] == len(back) // 576 and list(info["sync"]) == list(range(0, len(back) // 576, 12))
    assert media.read_container(b"") is None and media.read_container(b"\0\0\0\x09moovx") is None and media.read_container(blob[:-1]) is None
    got = {r["doc_id"]: r for r in media.text_media(docs).collect()}
    for i, t in docs.select("doc_id", "text").collect():
        p = media.pad(t.encode())
        assert got[i]["n_bytes"] == len(t.encode()) and got[i]["payload_bytes"] == len(p) and got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(p[-32:])
    cols = media.media_columns(media.store_texts(docs, ["doc_id"]), "media", ["doc_id"])
    r = cols.orderBy("doc_id").first()
    assert r["codec"] == "raw" and r["samples"] == got[r["doc_id"]]["payload_bytes"] // 576 and r["keyframes"][0]["bytes"] == 576


def test_sentencepiece_equals_merges_and_round_trips(spark, docs):
    v = sentencepiece.Vocabulary()
    e = sentencepiece.Encoder(v, memory=500)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeAB  \n\téñ☃聖🙂019.,!?") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", None, " ", "  x", "=" * 300]
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        ids, many = e.encode(part)
        at = np.append(0, np.cumsum(many))
        for t, x, y in zip(part, at[:-1], at[1:], strict=True):
            assert ids[x:y].tolist() == (sp.encode(t) if t else [])
    coded = sentencepiece.encode(docs)
    assert coded.where("not round_trip").count() == 0
    back = dict(sentencepiece.decode(coded).collect())
    assert back == dict(docs.select("doc_id", "text").collect())


def test_line_dedup_matches_brute_force(docs):
    got = {r["doc_id"]: list(r["kept_lines"]) for r in linededup.line_decisions(docs).collect()}
    first = {}
    for i, t in sorted(docs.select("doc_id", "text").collect()):
        for p, line in enumerate((t or "").split("\n")):
            if line.split():
                first.setdefault(line.strip(" ").lower(), (i, p))
    lines = list(first)
    sets = [frozenset(x[k : k + 5] for k in range(max(len(x) - 4, 1))) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                i = len(sets[a] & sets[b])
                if 100 * i >= 80 * len(sets[a] | sets[b]):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for k, line in enumerate(lines):
        best[find(k)] = min(best.get(find(k), (1 << 60, 0)), first[line])
    want = {i: [] for i in got}
    for i, p in best.values():
        want[i].append(p)
    assert got == {i: sorted(p) for i, p in want.items()}


def test_line_dedup_links_lines_without_spaces(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(20):
        line = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(500))
        at = rng.randrange(8)
        rows += [(2 * k, line, "zh", "s", 500), (2 * k + 1, line[:at] + "x" + line[at + 1 :], "zh", "s", 500)]
        want |= {2 * k: [0], 2 * k + 1: []}
    got = {r["doc_id"]: list(r["kept_lines"]) for r in linededup.line_decisions(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_line_dedup_recall_near_the_threshold(spark):
    """Of pairs at 0.8 to 0.85 (short lines, long ones, unspaced and CJK) at least 99 % are linked; pairs below 0.8 never."""
    rng = random.Random(12)

    def grams(x):
        return {x[k : k + 5] for k in range(max(len(x) - 4, 1))}

    kinds = [("abcdefghij     ", 30, 60), ("abcdefghijklmnopqrstuvwxyz", 100, 200), ("".join(map(chr, range(0x4E00, 0x5E00))), 40, 120), ("abcdefgh    ", 200, 400)]
    rows, alike = [], {}
    for kind, (letters, low, high) in enumerate(kinds):
        made = 0
        while made < 150:
            line = "x" + "".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) + "y"
            other = list(line)
            for _ in range(rng.randrange(1, 2 + len(line) // 40)):
                other[rng.randrange(1, len(other) - 1)] = rng.choice("01234")
            cut = rng.randrange(max(2, len(line) // 12))
            a, b = line, "".join(other)[: len(line) - cut] + "y" * (cut > 0)
            j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if 0.7 < j < 0.85:
                k = len(rows)
                rows += [(k, a, "en", "s", 1), (k + 1, b, "en", "s", 1)]
                alike[k + 1] = (kind, j >= 0.8)
                made += 1
    got = {r["doc_id"]: r["n_kept"] for r in linededup.line_decisions(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k] == 1 for k, (_, link) in alike.items() if not link)
    links = [k for k, (_, link) in alike.items() if link]
    assert len(links) > 150 and sum(got[k] == 0 for k in links) >= 0.99 * len(links)


def test_dedup_of_repeated_ids_with_other_texts(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"{long}\nfirst tail of one", "en", "s", 1), (1, f"{long}\nanother end", "en", "s", 1), (1, "plain", "en", "s", 1), (2, "plain\nnew line here", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    out = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_text(frame).collect())
    assert [x for x in out if x[0] == 2] == [(2, "new line here")]
    assert sorted(len(t.split("\n")) for i, t in out if i == 1) == [1, 1, 2]
    near = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, long, "en", "s", 1), (2, f"{long} end", "en", "s", 1)], DOCS)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(near, words=4).collect()]
    assert sorted(got) == [(1, 3, 1, True), (1, 37, 1, True), (2, 38, 1, False)]


def test_line_dedup_text(odd):
    out = linededup.dedup_text(odd)
    assert out.columns == odd.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert (5, "tie line\n\nend", 13) in got and (1, None, None) in got and (None, "no id here at all", 17) in got and (2, "", 0) in got


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(30)] = "vilexo" + rng.choice("abc")
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], int(r["doc_id"] % 5 == 0)) for r in got if r["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    shuffled = toxicity.toxicity(docs.repartition(5), known.repartition(3)).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in got} == {r["doc_id"]: round(r["score"], 9) for r in shuffled}


OPERATORS = {
    "quality": quality.quality, "neardup": neardup.near_duplicates, "sharding": sharding.shard, "mixing": mixing.mix, "media": media.text_media,
    "sentencepiece": sentencepiece.encode, "lines": linededup.line_decisions,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, name):
    got = OPERATORS[name](odd).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (r["doc_id"] for r in odd.collect())))
    assert OPERATORS[name](none).collect() == []


def test_odd_rows_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (4, None, None), (5, 0, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.count() > 0
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns
        assert f(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()
    assert sorted(str(r[0]) for r in kept) == sorted(["1", "2", "3", "4", "5", "6", "None"])


CLASHES = "_hash _kept _doc_id _id _times _k pipeline_hash pipeline_id line_hash line_kept LINE_DOC u root text_hash kept size target lang2".split()


def test_pipeline_stages_with_clashing_columns(spark, odd):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit("own "), F.coalesce("text", F.lit("none")).substr(1, 3)))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert {r[c] for c in CLASHES} and all(r[c].startswith("own ") for c in CLASHES), name


def test_pipeline_near_dedup_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(0, b, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, "x y", "en", "s", 2), (2, "x y", "de", "s", 1), (2, "x y", "de", "r", 9), (None, a, "en", "s", 1), (None, None, "en", "s", 1)]
    got = sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()), key=str)
    assert got == sorted([(0, b, "en", "s"), (1, a, "en", "s"), (2, "x y", "de", "r"), (None, None, "en", "s")], key=str)


def test_media_reader_survives_any_bytes():
    rng = random.Random(3)
    blob = media.write_container(media.pad(b"some text " * 700))
    head = blob.index(b"moov")
    cases = [blob[:k] for k in range(0, len(blob), 97)] + [b"\0\0\0\0moov" * 3000]
    for _ in range(1500):
        b = bytearray(blob)
        for _ in range(rng.randrange(1, 4)):
            b[rng.randrange(head, min(head + 900, len(b)))] = rng.choice((0, 1, 127, 255))
        cases.append(bytes(b))
    for b in cases:
        info = media.read_container(b)
        if info is not None:
            media.describe(info)
            media.read_payload(b, info)


def test_long_runs_take_linear_time():
    began = time.time()
    assert html.parse("<a '" * 100_000).kids
    import sentencepiece as library

    run = " " * 50_000 + "x"
    ids, many = sentencepiece.Encoder(sentencepiece.Vocabulary()).encode([run])
    assert ids[: many[0]].tolist() == library.SentencePieceProcessor(model_file=sentencepiece.MODEL).encode(run)
    assert time.time() - began < 20


def test_html_keeps_sections_of_the_article(spark):
    page = (
        "<html><body><div class='site-header'>top</div><article><h1>Title</h1><section class='related-work'><p>Work that is related.</p></section>"
        "<p>Body.</p><div class='comment-list'><p>first!</p></div><div class='share-buttons'>share</div></article><footer>end</footer></body></html>"
    )
    rows = spark.createDataFrame([(1, "http://a.b/1", page)], "page_id long, url string, html string")
    assert html.extract_pages(rows).first()["text"] == "Title\nWork that is related.\nBody."


ARTICLE = "<article><h1>Title</h1><p>First words here.</p><p>More words here.</p></article>"
BODY = "<h1>Title</h1><p>First words here.</p><p>More words here.</p>"
HIDDEN = "<nav>Home</nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout with-sidebar'>{HIDDEN}{ARTICLE}</div>",
        f"<div class='site header-fixed'>{ARTICLE}<div class='sidebar'>aside</div></div>",
        f"<div class='header'><main>{BODY}</main></div>",
        f"<div class='page with-sidebar'>{BODY}</div><div class='sidebar'>aside</div>",
        f"<div class='post-header'><h1>Title</h1></div><p>First words here.</p><p>More words here.</p>{HIDDEN}",
        f"<article><h1 title=it's>Title</h1><img src='data:{'x' * 5000}'><p data-a=\"{'>' * 6000}\">First words here.</p><p a=b=c d = 'e>' f>More words here.</article>",
        "<div>" * 400 + f"{ARTICLE}<nav><div>deep menu</div></nav><div class='menu'><ul><li>x</ul></div>" + "</div>" * 400,
        "<div>" * 130 + f"<nav>deep <b>menu</b><p>x</p></nav>{ARTICLE}" + "</div>" * 130,
        f"{ARTICLE}<div class='comment-list'><article class='comment'><p>{'a long comment ' * 30}</p></article></div>",
        f"<div id='content' class='main-content'>{BODY}</div><div class='cookie-notice'>We use cookies</div><form>search</form>",
    ],
)
def test_html_contract_cases(page):
    assert html.main_text(f"<html><body>{page}<footer>end</footer></body></html>", None) == "Title\nFirst words here.\nMore words here."


def test_broken_attributes_cost_linear_time():
    began = time.time()
    for bad in ("<a '", "<a b=\"", "<a b='\" ", "<p title=", "<a b=\"c' ", "<!-- ", "<a =", "<" * 3):
        html.parse(bad * 60_000)
    assert time.time() - began < 20


def plain_blocks(tree):
    """Text of a generated tree: nested (tag, class, kids or text), by the contract alone."""
    tag, name, body = tree
    if tag in ("nav", "footer", "aside", "form") or name in ("sidebar", "comments", "cookie-notice", "ad"):
        return []
    return [" ".join(body.split())] if isinstance(body, str) else [x for kid in body for x in plain_blocks(kid)]


def test_html_matches_plain_extraction_of_generated_pages(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    mark = lambda tree: f"<{tree[0]}" + (f" class='{tree[1]}'" if tree[1] else "") + ">" + (tree[2] if isinstance(tree[2], str) else "".join(map(mark, tree[2]))) + f"</{tree[0]}>"
    rows, want = [], {}
    for i in range(60):
        parts = [("h1", "", f"T {word()}")]
        for _ in range(rng.randrange(2, 9)):
            kind = rng.randrange(6)
            parts.append([("p", "", f" {word()}  {word()}\n{word()} "), ("ul", "", [("li", "", word()), ("li", "x", word())]), ("div", "note", [("p", "", word())]), ("aside", "", word()), ("div", "ad", [("p", "", word())]), ("blockquote", "", [("p", "", word()), ("p", "", word())])][kind])
        layout = ("div", "layout with-sidebar", [("nav", "", [("ul", "", [("li", "", "Home")])]), ("article", "", parts), ("div", "sidebar", [("p", "", word())])]) if i % 2 else ("main", "", parts)
        tree = ("body", "", [("header", "", "Site"), layout, ("div", "comments", [("p", "", word())]), ("div", "cookie-notice", "ok"), ("footer", "", "end")])
        rows.append((i, f"http://h{i % 3}/{i}", "<html>" + mark(tree) + "</html>"))
        want[i] = "\n".join(x for x in plain_blocks(layout))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_grown_components_equal_a_fresh_start(spark):
    from quarry.llm.shared import grown

    rng = random.Random(17)
    old, new = ([(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (40, 25))
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    got = sorted(map(tuple, grown(components(frame(old)), frame(new), "t").collect()))
    assert got == sorted(map(tuple, components(frame(old + new)).collect()))


def test_quality_models_are_whole_and_tell_word_order(spark):
    """nothing is folded, models grow with the corpus and see whole words; the Spark model equals the plain one."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("bdklmnrst") + rng.choice("aeio") for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    texts = [" ".join(rng.choice(pool) for _ in range(120)) + " 漢字 и é" for _ in range(40)]
    counts = quality.count_ngrams(spark.createDataFrame([("en", x) for x in texts], "lang string, text string"))
    brute = {}
    for x in texts:
        b = quality.EDGE * (quality.ORDER - 1) + x.encode() + quality.EDGE * (quality.ORDER - 1)
        for i in range(len(b) - quality.ORDER + 1):
            k = int.from_bytes(b[i : i + quality.ORDER], "big")
            brute[k] = brute.get(k, 0) + 1
    assert {r["key"]: r["n"] for r in counts.collect()} == brute
    keys = np.array(sorted(brute), np.int64)
    plain = quality.estimate(keys, np.array([brute[int(k)] for k in keys]), quality.ORDER)
    got = quality.arrays(quality.fit_models(counts).toArrow())
    assert got.keys() == plain.keys() and all(np.allclose(got[k], plain[k], atol=1e-9) for k in plain)
    for ctx in (int(keys[0]) // 256, int(keys[999]) // 256, 5):
        assert np.exp(quality.look_up(got, ctx * 256 + np.arange(256))).sum() == pytest.approx(1.0, abs=1e-9)
    # words that don't occur stand out, though all their trigrams do
    chained = " ".join("".join(rng.choice(pool)[:2] for _ in range(4)) for _ in range(120))
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(texts)] + [(100, chained, "en", "s", 1)]
    found = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[i]["kept"] for i in range(40))
    assert found[100]["log_ppl"] > max(found[i]["log_ppl"] for i in range(40))
