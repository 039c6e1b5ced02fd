"""Operators on records: URL filters, sharding, places, quotation linking, the pipeline."""

import importlib
import random
from collections import Counter
from hashlib import md5
from math import log
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries, quotes, ranks, sharding, urls


def rule_by_hand(host, path):
    best = None
    for kind, rule in queries.RULES:
        at, _, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return best


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    slash = rest.index("/") if "/" in rest[:cut] else cut
    return "".join(c.lower() if c.isascii() else c for c in rest[:slash]), rest[slash:cut]


def page_by_hand(host, path):
    return host.removeprefix("www.") + path.rstrip("/")


ODD_URLS = [None, "", "x", "://", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "http://anet/", "ftp://u.Example.NET/en/1?x#y", "http://example.net/en", "http://É.org/fr/#", "http://a.org?fr/", "a://b.org/fr/\nq://c", "http://www.p.xyz/a//", "https://p.xyz/a?utm_source=1", "http://q.xyz"]


def test_urls_by_hand(spark):
    rows = [*enumerate(ODD_URLS), (3, "://"), (None, "http://q.xyz")]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, block string, bits int")
    keys = spark.createDataFrame([("p.xyz/a",), ("p.xyz/a",), (None,), ("",), ("net/x",)], "page string")
    listed = {"p.xyz/a", "net/x"}
    want = []
    for i, u in rows:
        host, path = parts_by_hand(u)
        fit = rule_by_hand(host, path)
        want.append(str((i, host, path, fit[1] if fit else None, fit[0] if fit else "block" if page_by_hand(host, path) in listed else "allow")))
    assert sorted(str(tuple(r)) for r in urls.filter_urls(pages, keys, queries.RULES).collect()) == sorted(want)
    none = keys.where("false")
    assert urls.filter_urls(pages, none, queries.RULES).count() == len(rows) and urls.filter_urls(pages.where("false"), keys, queries.RULES).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    blocks = 5000 // urls.KEYS_PER_BLOCK
    table = urls.bloom(keys, "k", blocks)
    probe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), "id")
    joined = probe.join(table, urls._block(F.col("k"), blocks) == F.col("block")).where(F.col("bits").bitwiseAND(urls._mask(F.col("k"))) == urls._mask(F.col("k")))
    assert joined.where("id < 5000").count() == 5000
    assert joined.where("id >= 5000").count() < 0.2 * 15000
    clash = probe.select(F.col("k").alias("bits"), F.lit(1).alias("_block"), F.col("id").alias("block"))
    assert urls.listed(clash, "bits", keys).where("listed").count() == 5000


def test_url_query_is_native(spark):
    plan = queries.QUERIES["op9_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def draw(key, shard, weight):
    return -weight / log((int(md5(f"{key}:{shard}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60)


def test_shards_by_hand(spark, documents, no_documents):
    texts = documents.select("doc_id", "text").union(spark.range(100, 700).select("id", F.lit("t")))
    weights = [1.0, 2.0, 1.0, 0.5]
    rows = sharding.measured(texts).withColumn("_row", F.lit("x")).withColumn("shard", F.lit(9))
    got = sharding.shard_rows(rows, "doc_id", ["text_crc32", "size"], weights, [1.0]).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(str((r.doc_id, len((r.text or "").encode()) + 16, crc32((r.text or "").encode()))) for r in texts.collect())
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        draws = [draw(key, i, w) for i, w in enumerate([*weights, 1.0])]
        assert r.shard == max(range(4), key=draws.__getitem__) and r.grown_shard == max(range(5), key=draws.__getitem__)
        assert r.grown_shard in (r.shard, 4)
    sizes = Counter(r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in sizes.items() for i in range(n))
    assert 0.3 < sizes[1] / len(got) < 0.6
    order = sorted((r for r in got if r.shard == 1), key=lambda r: r.slot)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda d: (d is not None, d))
    assert sharding.shard_rows(sharding.measured(no_documents), "doc_id", [], weights).count() == 0


def test_places_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") % 5).alias("o"), F.lit(1).alias("_range")).unionByName(spark.createDataFrame([(None, None, 1)] * 4, "g string, o long, _range int"))
    got = ranks.placed(rows, "g", ["o"], "at").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r["at"], r.o))
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        assert [o for _, o in places] == sorted((o for _, o in places), key=lambda o: (o is not None, o))
    assert len(got) == 3004


TALK = [
    (1, 0, "user", "Where is the old map of the town?\nI looked for it everywhere today."),
    (1, 1, "assistant", "It hangs in the north hall, next to the door."),
    (1, 2, "user", "On Monday someone wrote:\n> Where is the old map of the town?\n> I looked for it everywhere today.\nI saw it there last year."),
    (1, 3, "user", ">> Where is the old map of the town?\n> I saw it there last year.\nSo it must be there still."),
    (1, 4, "user", "> something that nobody said here\nNo idea at all."),
    (1, 5, "user", "> IT hangs in the   north hall, next to the door.\n\nThank you for this."),
    (2, 0, "user", "> Where is the old map of the town?\nA quote from another talk."),
    (2, 1, "user", None),
    (None, 0, "user", "A message without a talk of its own."),
    (2, None, "user", "No turn is known for this."),
    (2, 1, "user", ""),
]


def test_quotes(spark):
    schema = "conv_id long, turn long, role string, text string, body int, words int"
    got = quotes.link(spark.createDataFrame([(*t, 1, 2) for t in TALK], schema)).collect()
    assert len(got) == len(TALK)
    by = {(r.conv_id, r.turn): r for r in got}
    replies = {k: r.reply_to for k, r in by.items() if r.reply_to is not None}
    assert replies == {(1, 2): 0, (1, 3): 2, (1, 5): 1}
    assert by[1, 3].thread == 0 and by[1, 3].deepest == 2 and by[1, 4].n_quotes == 1
    assert by[1, 2].body == "I saw it there last year." and by[1, 5].body == "Thank you for this."
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.place)] == [0, 2, 3, 1, 5, 4]
    for conv in (1, 2, None):
        places = sorted(r.place for r in got if r.conv_id == conv)
        assert places == list(range(len(places)))
    assert quotes.link(spark.createDataFrame([], schema)).count() == 0


def test_short_quotes_and_scripts_without_spaces(spark):
    said = ["Yes.", "我们明天在图书馆见面吧。", "ขอบคุณมาก", "はい\n了解しました", "👍", "The plan is good.\nThanks!\nSee you."]
    rows = [(i, 0, "user", x) for i, x in enumerate(said)] + [(i, 1, "user", "Something else.") for i in range(len(said))]
    rows += [(i, 2, "user", f"> {x.splitlines()[-1] if i < 5 else 'Thanks!'}\nAn answer.") for i, x in enumerate(said)]
    rows += [(9, 0, "user", "Yes it is"), (9, 1, "user", "我们明天在图书馆见面吧。"), (9, 2, "user", "> Yes it is\n> 我们明天在图书馆见面吧。\nBoth.")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    replies = {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None}
    assert replies == {(i, 2): 0 for i in range(len(said))} | {(9, 2): 1}


def test_origins_of_every_level(spark):
    first, second = "The bridge is closed today.", "Since when has it been closed?"
    rows = [(c, i, "user", x) for c in (1, 2, 3) for i, x in enumerate((first, second))]
    rows += [(1, 2, "user", f">> {first}\nI see."), (2, 2, "user", f"> no words of this talk\n>> {first}\nI see."), (3, 2, "user", f"> {second}\n>> {first}\nSince noon.")]
    got = {r.conv_id: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.turn == 2}
    assert {c: (r.reply_to, r.thread) for c, r in got.items()} == {1: (0, 0), 2: (0, 0), 3: (1, 1)}
    assert {c: [tuple(x) for x in r.origins] for c, r in got.items()} == {1: [(2, 0)], 2: [(2, 0)], 3: [(1, 1), (2, 0)]}


WORDS = ["yes", "no", "the bridge", "is closed", "ok", "我们", "since noon", "who says so", "👍", "north hall", "?"]


def thread_of(rng, size):
    """Messages that quote earlier ones whole, by paragraph or by line, with deeper levels, attributions and noise."""
    texts = []
    for turn in range(size):
        parts = []
        if texts and rng.random() < 0.8:
            cited = texts[rng.randrange(len(texts))].split("\n")
            if rng.random() < 0.5:
                at = rng.randrange(len(cited))
                cited = cited[at : at + rng.randrange(1, 4)]
            if rng.random() < 0.4:
                parts.append(rng.choice(["On Monday somebody wrote:", "Am Montag schrieb jemand:", "Le 3 mai, quelqu'un a écrit :", "El lunes alguien escribió:"]))
            parts += [(">" if x.startswith(">") else "> ") + rng.choice([x, x.upper(), x.replace(" ", "   ")]) for x in cited]
        for _ in range(rng.randrange(4)):
            parts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 3)))] + ([""] if rng.random() < 0.3 else [])
        texts.append("\n".join(parts))
    return texts


def told(text):
    """Own lines and quoted blocks (level, lines), read mark by mark."""
    lines = []
    for line in text.split("\n"):
        rest, level = line.lstrip(" \t") if line.lstrip(" \t").startswith(">") else line, 0
        while rest.startswith(">"):
            rest, level = rest[1:], level + 1
            rest = rest[1:] if rest[:1] in (" ", "\t") else rest
        lines.append((level, rest))
    own, blocks = [], []
    for i, (level, line) in enumerate(lines):
        after = [n for n, x in lines[i + 1 :] if n or x.strip()][:1]
        if level:
            if i and lines[i - 1][0] == level:
                blocks[-1][1].append(line)
            else:
                blocks.append((level, [line]))
        elif not (after and after[0] and line.rstrip(" :").endswith(("wrote", "jemand", "écrit", "escribió"))):
            own.append(line)
    return own, blocks


def said_in(lines):
    """Every passage as its words, with how many they are."""
    paragraphs, held = [], []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line)
        else:
            paragraphs, held = [*paragraphs, " ".join(held)], []
    out = {}
    for part in (" ".join(lines), *paragraphs, *lines):
        if words := part.lower().split():
            out[" ".join(words)] = max(len(words), sum("\u3400" <= c <= "\u9fff" for c in part))
    return out


def test_links_of_generated_threads(spark):
    rng = random.Random(11)
    talks = {c: thread_of(rng, rng.randrange(2, 12)) for c in range(60)}
    want = {}
    for c, texts in talks.items():
        first, roots = {}, {}
        for turn, text in enumerate(texts):
            own, blocks = told(text)
            found = {}
            for level, lines in blocks:
                for passage, n in said_in(lines).items():
                    if passage in first:
                        found[level] = max(found.get(level, (0, 0)), (n, first[passage]))
            origins = [(level, at) for level, (_, at) in sorted(found.items())]
            reply = origins[0][1] if origins else None
            roots[turn] = turn if reply is None else roots[reply]
            want[c, turn] = (origins, reply, roots[turn], "\n".join(own).strip("\n"))
            for passage in said_in("\n".join(own).strip("\n").split("\n")):
                first.setdefault(passage, turn)
    rows = [(c, i, "user", x) for c, texts in talks.items() for i, x in enumerate(texts)]
    rng.shuffle(rows)
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    assert {(r.conv_id, r.turn): ([tuple(x) for x in r.origins or []], r.reply_to, r.thread, r.body) for r in got} == want
    assert sum(reply is not None for _, reply, _, _ in want.values()) > 150 and any(len(o) > 1 for o, *_ in want.values())
    for c in talks:
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.place)
        assert [(r.thread, r.turn) for r in mine] == sorted((r.thread, r.turn) for r in mine) and [r.place for r in mine] == list(range(len(mine)))


def test_the_highest_hash_has_a_draw(spark):
    top = spark.createDataFrame([(sharding.SCALE - 1,), (0,)], "h long").select(sharding.uniform(F.col("h")).alias("u")).collect()
    assert all(0 < r.u < 1 and log(r.u) < 0 for r in top)


def test_ranges_follow_the_rows(spark):
    rows = spark.range(2000).select(F.lit("one").alias("g"), (F.col("id") * 7 % 2000).alias("o"))
    got = ranks.placed(rows, "g", ["o"], "at", rows_per_range=50)
    assert got.filter("at <> o").count() == 0 and got.count() == 2000


def test_long_reply_chains(spark):
    said = [f"this is message number {i} of the long talk" for i in range(40)]
    rows = [(1, i, "user", (f"> {said[i - 1]}\n" if i else "") + said[i]) for i in range(40)]
    random.Random(1).shuffle(rows)
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.thread for r in got} == {0} and all(r.reply_to == (r.turn - 1 if r.turn else None) for r in got)


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert docs.count() > 0
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    good = {r.doc_id for r in queries.QUERIES["op2_quality_rules"](spark, folder).collect() if r.kept}
    assert {r.doc_id for r in docs.collect()} <= good


def test_pipeline_of_nothing(spark, no_documents, tmp_path):
    folder = str(tmp_path)
    no_documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("name", ["batches", "bpe", "quality", "suffixes", "neardup"])
def test_modules_import_alone(name):
    assert importlib.import_module(f"millrace.llm.{name}")
