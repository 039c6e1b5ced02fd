"""Operators on words: quality rules, decontamination, near duplicates, licenses."""

import random
import re
import time
from hashlib import sha256
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import batches, decontaminate, licenses, neardup, quality, queries
from millrace.llm.components import components

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_by_hand(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


OPTIONS = quality.Fertility(public_tokenizers.path("piece_bpe_32k.model"))


def test_quality_by_hand(spark, documents):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=OPTIONS.vocabulary)
    for table in (documents, texts):
        rows = {str((r.doc_id, r.text)): r for r in table.collect()}
        for r in quality.judge(table, OPTIONS).collect():
            text = rows[str((r.doc_id, r.text))].text
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_by_hand(text)
            ids = [i for w in SPACED.findall(text or "") for i in model.encode(w)]
            assert r.n_tokens == len(ids) and not (r.base_failed and r.kept)
            if ids:
                share = np.unique(ids, return_counts=True)[1] / len(ids)
                assert abs(r.token_bits + (share * np.log2(share)).sum()) < 1e-6
                assert abs(r.byte_share - sum(map(model.is_byte, ids)) / len(ids)) < 1e-9


def test_bands_reject_by_language_and_script(spark):
    random.seed(2)
    plain = "The committee of the town met in the old hall to speak about roads, schools and the price of bread before winter. Most members had come by foot, because snow had closed the bridge, and the mayor asked for short speeches. A baker explained why flour costs more this year; two farmers answered that rain spoiled their fields. After an hour everyone agreed to repair the northern road first, to open one new classroom, and to wait with all other plans until spring."
    signs = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从"
    soup = " ".join("".join(random.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(120))
    runes = " ".join("".join(chr(random.randrange(0x16A0, 0x16EA)) for _ in range(5)) for _ in range(80))
    rows = [(1, plain, "en"), (2, soup, "en"), (3, runes, "en"), (4, plain, None), (5, " ".join("".join(random.choices(signs, k=4)) for _ in range(80)), "zh")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), OPTIONS).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


PROSE = {
    "de": "Der Rat der Stadt kam im alten Saal zusammen, um über Straßen, Schulen und den Preis des Brotes vor dem Winter zu sprechen. Die meisten waren zu Fuß gekommen, weil Schnee die Brücke gesperrt hatte, und der Bürgermeister bat um kurze Reden. Ein Bäcker erklärte, warum Mehl in diesem Jahr mehr kostet; zwei Bauern antworteten, dass Regen ihre Felder verdorben habe.",
    "fr": "Le comité de la ville s'est réuni dans la vieille salle pour parler des routes, des écoles et du prix du pain avant l'hiver. La plupart des membres étaient venus à pied, car la neige avait fermé le pont, et le maire demanda des discours brefs. Un boulanger expliqua pourquoi la farine coûte plus cher cette année; deux paysans répondirent que la pluie avait gâté leurs champs.",
    "es": "El comité de la ciudad se reunió en la sala vieja para hablar de caminos, escuelas y del precio del pan antes del invierno. La mayoría de los miembros había venido a pie, porque la nieve había cerrado el puente, y el alcalde pidió discursos cortos. Un panadero explicó por qué la harina cuesta más este año; dos campesinos respondieron que la lluvia arruinó sus campos.",
    "pl": "Komitet miasta spotkał się w starej sali, aby mówić o drogach, szkołach i cenie chleba przed zimą. Większość członków przyszła pieszo, ponieważ śnieg zamknął most, a burmistrz poprosił o krótkie przemówienia. Piekarz wyjaśnił, dlaczego mąka kosztuje w tym roku więcej; dwaj rolnicy odpowiedzieli, że deszcz zniszczył ich pola. Po godzinie wszyscy zgodzili się najpierw naprawić północną drogę.",
}


def test_letter_soup_of_any_size_falls_out(spark):
    rng = random.Random(4)
    kinds = [("abcdefghijklmnopqrstuvwxyz", 9, 14), ("abcdefghijklmnopqrstuvwxyz", 8, 14), ("bcdfghjklmnpqrstvwxz", 9, 9)]
    soups = [" ".join("".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)) for letters, low, high in kinds for n in (50, 120, 1000) for _ in range(8)]
    rows = [(0, s, lang) for s in soups for lang in ("en", "de", "fr", "es", "it", None)]
    rows += [(1, text, lang) for code, text in PROSE.items() for lang in (code, None)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), OPTIONS).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(0, False), (1, True)}
    clean = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), OPTIONS)
    assert clean.where("not base_failed and not kept").count() == 0


def test_kept_rows_keep_their_columns(documents, no_documents):
    kept = quality.keep_good(documents, OPTIONS)
    assert kept.schema == documents.schema
    assert kept.count() == quality.judge(documents, OPTIONS).where("kept").count()
    assert quality.judge(no_documents, OPTIONS).count() == quality.keep_good(no_documents, OPTIONS).count() == 0


def test_index_by_hand():
    rng = np.random.default_rng(0)
    for size in (1, 2, 50, 400):
        text = rng.integers(1, 4, size)
        text[rng.integers(0, size, size // 10 + 1)] = 0
        text[-1] = 0
        index = decontaminate.FMIndex(text)
        assert sorted(index.locate(np.arange(size)).tolist()) == list(range(size))
        phrases = np.array([[a, b, c] for a in (1, 2, 3, 5) for b in (1, 2, 3) for c in (0, 1, 2)])
        lengths = (phrases > 0).sum(axis=1)
        low, high = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
            want = [i for i in range(size - n + 1) if (text[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def hits_by_hand(text, items):
    words, hit, names = ALNUM.findall(lowered(text)), set(), set()
    for name, phrase in items:
        own = ALNUM.findall(lowered(phrase))
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    names |= {str(name)} if name is not None else set()
    return len(words), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_by_hand(spark, documents, no_documents, monkeypatch):
    random.seed(6)
    vocabulary = ["a", "B", "cé", "dd", "e1"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randrange(14)))) for i in range(25)] + [(3, "x y"), (None, "a b c d e f g h i j"), (40, None), (41, "...")]
    texts = [" ".join(random.choices(vocabulary, k=random.randrange(80))) + random.choice(["", "!x Y", "."]) for _ in range(80)]
    items.append((42, " ".join(random.choices(vocabulary, k=60))))  # comes in pieces where blocks are small
    texts += [" ".join(items[-1][1].split()[a:b]) + " zz" for a, b in ((0, 60), (3, 14), (11, 47), (50, 60), (51, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(documents.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str((r.doc_id, *hits_by_hand(r.text, items))) for r in docs.collect())
    assert sorted(str(tuple(r)) for r in decontaminate.contamination(docs, bench).collect()) == want
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (5,))  # several blocks
    assert sorted(str(tuple(r)) for r in decontaminate.contamination(docs, bench).collect()) == want
    cut = decontaminate.remove_hits(docs.withColumn("_spans", docs.text), bench, length=None)
    assert cut.columns == ["doc_id", "text", "_spans"]
    for r in cut.collect():
        assert len(ALNUM.findall(lowered(r.text))) <= len(ALNUM.findall(lowered(r._spans)))
    again = {str((r.doc_id, r._spans)): r.text for r in cut.collect()}
    for r in docs.collect():
        words, hit = hits_by_hand(r.text, items)[:2]
        if not hit:
            assert again[str((r.doc_id, r.text))] == r.text
        else:
            assert len(ALNUM.findall(lowered(again[str((r.doc_id, r.text))]))) in range(words - hit - 60, words - hit + 1)
    none = spark.createDataFrame([], bench.schema)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(no_documents, bench).count() == 0


def shingles_by_hand(text):
    words = SPACED.findall(lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_by_hand(rows):
    sets = [shingles_by_hand(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least[x] = min([d for d in (least.get(x), doc) if d is not None], default=None)
    return [(doc, len(s), least[x], doc is not None and doc == least[x]) for (doc, _), s, x in zip(rows, sets, label, strict=True)]


def family(rng, words, copies, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = [base]
    for _ in range(copies):
        own = list(rng.choice(out))
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(own)
    return [" ".join(x) for x in out]


def test_near_duplicates_by_hand(spark, documents, no_documents, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = [t for n, e in ((120, 6), (20, 3), (5, 8), (60, 12)) for t in family(rng, words, n, e)] + ["a b c", "A b  c", "a b c d"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, components_by_hand(rows)))
    assert sorted(str(tuple(r)) for r in neardup.near_duplicates(docs).collect()) == want
    monkeypatch.setattr(neardup, "TILE", 16)  # large buckets over several tiles
    assert sorted(str(tuple(r)) for r in neardup.near_duplicates(docs).collect()) == want
    kept = neardup.one_of_each(docs.withColumn("_digest", docs.text))
    ids = [r.doc_id for r in kept.collect()]
    expected = {x[0] for x in components_by_hand(rows) if x[3]}
    assert {i for i in ids if i is not None} == expected and len([i for i in ids if i is not None]) == len(expected)
    assert neardup.near_duplicates(no_documents).count() == neardup.one_of_each(no_documents).count() == 0


def test_chains_are_one_component(spark):
    links = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.key: r.label for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len({got[f"{i:03d}"] for i in range(61)}) == 1 and got["x"] == got["y"] and "z" not in got and len(set(got.values())) == 2


def test_patience():
    rng = random.Random(3)
    for _ in range(200):
        values = rng.sample(range(30), rng.randrange(12))
        best = max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(c)), default=0)
        kept = [values[i] for i in licenses.longest_rising(values)]
        assert kept == sorted(kept) and len(kept) == best
        left, right = [rng.randrange(9) for _ in range(15)], [rng.randrange(9) for _ in range(12)]
        pairs = licenses.align(left, right)
        assert all(left[i] == right[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    words = list(range(40))
    assert licenses.align([99] * 7 + words[:20] + [98] + words[20:] + [99], words) == [(i + 7 + (i >= 20), i) for i in range(40)]


def test_licenses(spark, documents, no_documents):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(texts).collect()}
    for r in texts.collect():
        for name in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0-work", "MIT"):
            if licenses.TEMPLATES[name] in r.text:
                assert got[r.doc_id].license == name and got[r.doc_id].coverage == 1.0
                assert r.text.encode()[got[r.doc_id].start_byte : got[r.doc_id].end_byte].decode() in licenses.TEMPLATES[name]
        if "icens" not in r.text:
            assert got[r.doc_id].license is None and got[r.doc_id].coverage == 0
    changed = "words before. " * 400 + "PERMISSION is hereby granted free of charge, to any one person obtaining a copy of the software and associated documentation files to deal in the Software, without restriction!" + " words after" * 300
    rows = [(1, changed), (2, None), (3, "granted permission")]
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "MIT-text", 2: None, 3: None}
    assert licenses.scan(documents, {"nothing": "", **licenses.TEMPLATES}).count() == documents.count() and licenses.scan(no_documents).count() == 0


def test_notices_behind_denser_decoys(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    table = "4 0 7 1 0 4 9 0 2 4 8 0 3 5 4 6 1 0 9 7 3"
    far = " word of another kind" * 60
    mit, sa = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["CC-BY-SA-4.0"]
    rows = [(1, apache + far + " " + mit), (2, mit + far + " " + apache), (3, table + far + " " + sa), (4, sa + far + " " + table), (5, f"{mit} {mit} the the {mit}"), (6, far + " under the MIT License under the MIT License" + far), (7, apache), (8, table)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("MIT" in got[i].licenses.split(",") for i in (1, 2, 5, 6)) and "MIT" not in got[7].licenses.split(",")
    for i, name, notice in ((3, "CC-BY-SA-4.0", sa), (4, "CC-BY-SA-4.0", sa), (5, "MIT", mit)):
        assert (got[i].license, got[i].coverage, rows[i - 1][1][got[i].start_byte : got[i].end_byte]) == (name, 1.0, notice.rstrip("."))
    assert got[6].license == "MIT" and got[6].coverage == 0.8 and got[8].license is None


def subsequence_by_hand(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        above, row = row, [0]
        for j, b in enumerate(right):
            row.append(above[j] + 1 if a == b else max(above[j + 1], row[j]))
    return row[-1]


def edited(rng, words, share):
    """The words with some replaced, doubled, left out or followed by strange ones; the first and last stay."""
    out = []
    for w in words[1:-1]:
        kind = rng.random() / share
        out += [[-1], [w, w], [], [w, -1, -1]][int(kind * 4)] if kind < 1 else [w]
    return [words[0], *out, words[-1]]


def test_best_notice_by_hand():
    """Pairs never exceed a longest common subsequence; an edited copy is found where it was put, behind decoys, too."""
    rng = random.Random(5)
    found = 0
    for _ in range(300):
        words = [rng.randrange(6) for _ in range(rng.randrange(1, 6))]
        text = np.array([rng.choice([-1, -1, 7, *range(6)]) for _ in range(rng.randrange(60))], dtype=np.int64)
        pairs = licenses.best_notice(text, np.flatnonzero(np.isin(text, words)), licenses.Template("t", words), 0.8)
        best = max((subsequence_by_hand(text[i : i + 4 * len(words)].tolist(), words) for i in range(len(text))), default=0)
        assert not pairs or 0.8 * len(words) <= len(pairs) <= best
        assert all(text[i] == words[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        exact = [i for i in range(len(text)) if text[i : i + len(words)].tolist() == words]
        if exact:
            found += 1
            assert [i for i, _ in pairs] == list(range(exact[0], exact[0] + len(words)))
    assert found > 50
    for case in range(200):
        words = list(range(40)) if case % 2 else [rng.choice([*range(30), 0, 0, 1]) for _ in range(40)]
        words[0], words[-1] = 50, 51
        copy = edited(rng, words, 0.12)
        decoy = [rng.choice([*words, -1, -1, -1]) for _ in range(120)]
        half = words[: 20] if case % 3 else words[20:]
        strange = [-1] * 100
        parts = [decoy, strange, copy, strange, half, strange]
        if case % 5 == 0:
            parts = [half, strange, decoy, strange, copy, strange]
        place = sum(map(len, parts[: parts.index(copy)]))
        text = np.array(sum(parts, []), dtype=np.int64)
        pairs = licenses.best_notice(text, np.flatnonzero(np.isin(text, words)), licenses.Template("t", words), 0.8)
        best = subsequence_by_hand(copy, words)
        if best < 33:
            continue
        assert (pairs[0][0], pairs[-1][0]) == (place, place + len(copy) - 1)
        assert len(pairs) == best if case % 2 else len(pairs) >= 32


def test_copies_one_after_another():
    """Each copy lacks words; the best covered of them is taken, not pieces of several."""
    words = list(range(30))
    copies = [[w for w in words if w % 30 not in lost] for lost in ({3, 4, 20}, {7}, {9, 11})]
    text = np.array([-1, *copies[0], -1, -1, *copies[1], -1, *copies[2], -1], dtype=np.int64)
    pairs = licenses.best_notice(text, np.flatnonzero(text >= 0), licenses.Template("t", words), 0.8)
    assert len(pairs) == 29 and pairs[0][0] == 1 + 27 + 2


def test_choice_among_whole_licenses(spark):
    """Whole texts with changed holders, wrapped lines and comment signs; the best covered is the license, all are listed."""
    far = " word of another kind" * 80
    spoken = lambda name: licenses.LICENSES[name].replace("\n", "\n * ")
    rows = [(i, f"Copyright someone\n * {spoken(name)}{far}") for i, name in enumerate(licenses.LICENSES)]
    rows.append((100, far + spoken("ISC").replace("AUTHOR", "PEOPLE") + far + spoken("Zlib")))
    rows.append((101, licenses.LICENSES["MIT-license"][:300] + far))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.LICENSES).collect()}
    for i, name in enumerate(licenses.LICENSES):
        assert (got[i].license, got[i].coverage) == (name, 1.0)
        assert rows[i][1][got[i].start_byte : got[i].end_byte].split()[0].strip("(") == licenses.LICENSES[name].split()[0]
    assert (got[100].license, got[100].licenses) == ("Zlib", "ISC,Zlib") and got[101].license is None


def test_long_template_in_long_text(tmp_path):
    """A template of 6,000 words and an edited copy in 20,000 words, among words of the template in any order."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(900)]
    words = [rng.choice(common) if rng.random() < 0.8 else f"own{i}" for i in range(6000)]
    (tmp_path / "long.txt").write_text(" ".join(words))
    (tmp_path / "short.txt").write_text("Released under the Short License.")
    templates = licenses.read_templates(str(tmp_path))
    assert list(templates) == ["long", "short"]
    copy = [w for w in words if rng.random() > 0.03]
    text = [rng.choice([*common[:300], "strange"]) for _ in range(7000)] + copy + ["strange"] * 7000
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(text)]})
    begin = time.process_time()
    (out,) = licenses._scan(licenses.compiled(templates), 0.8)(iter([batch]))
    took = time.process_time() - begin
    row = out.to_pylist()[0]
    assert row["license"] == "long" and row["coverage"] > 0.95
    at = len(" ".join(text[:7000]))
    assert abs(row["start_byte"] - at) < 60 and abs(row["end_byte"] - len(" ".join(text[: 7000 + len(copy)]))) < 60
    assert took < 8  # two seconds on an idle core


def test_words_end_with_their_row():
    data, offsets = batches.utf8(pa.array(["ab", "cd", None, "", "e f"]))
    starts, ends, rows = batches.words(data, offsets, batches.SPACED)
    assert [(data[a:b].tobytes().decode(), r) for a, b, r in zip(starts, ends, rows, strict=True)] == [("ab", 0), ("cd", 1), ("e", 4), ("f", 4)]


def near_threshold(rng, members, changed):
    """Texts of 200 words, each with its own changes to one base: many pairs lie just below or above the threshold."""
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(members):
        own = list(base)
        for j in rng.sample(range(200), changed):
            own[j] = f"x{i}y{j}"
        out.append(" ".join(own))
    return out


def test_a_family_around_the_threshold(spark, monkeypatch):
    rng = random.Random(4)
    rows = list(enumerate(near_threshold(rng, 160, 3) + near_threshold(rng, 160, 4)))
    sets = [shingles_by_hand(t) for _, t in rows]
    near = [100 * len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    assert sum(70 <= x < 75 for x in near) > 5000 and sum(x >= 75 for x in near) > 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, components_by_hand(rows)))
    for tile, items in ((512, 1 << 21), (1, 1 << 21), (50, 3000)):  # one tile; each set in its own; small by size, too
        monkeypatch.setattr(neardup, "TILE", tile)
        monkeypatch.setattr(neardup, "TILE_ITEMS", items)
        assert sorted(str(tuple(r)) for r in neardup.near_duplicates(docs).collect()) == want


def test_rows_grow_with_members_not_pairs(spark):
    """Nothing but members is exchanged for a family just below the threshold, and few links come out."""
    rng = random.Random(5)
    docs = spark.createDataFrame(list(enumerate(near_threshold(rng, 400, 7))), "doc_id long, text string")
    rows = neardup.stage(neardup.signatures(docs), "t")
    reps = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "odd", "parity", "bands")])
    banded = reps.select("key", "n", F.explode("bands").alias("band"))
    members = banded.join(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band")
    labels = spark.createDataFrame([], "key binary, label binary")
    texts = rows.join(docs, "doc_id").select("key", "text")
    found = neardup._other_links(members, reps.drop("n"), texts, labels)
    assert found.count() < 400


def swapped(n, a="b", b="g"):
    """Two texts of n letters that all sums of powers of one base modulo 2**64 take for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_lines_and_chunks_that_fool_power_sums(spark, size):
    one, two = swapped(size)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert all(not r.contaminated for r in decontaminate.contamination(docs.where("doc_id = 2"), docs.where("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text")).collect())
    assert [r.component_id for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2]
    lines = spark.createDataFrame([(1, f"{one}\n{two}\n", "en")], "doc_id long, text string, lang string")
    assert quality.judge(lines, queries.fertility()).head().n_dup_lines == 0
    data = np.frombuffer((one + two).encode(), dtype=np.uint8)
    for seed in (0, 3, 4, 21, 22):
        a, b = batches.span_hashes(data, np.array([0, size]), np.array([size, 2 * size]), seed)
        assert a != b


def test_span_hashes_of_every_length():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4700, 3000)
    ends = starts + rng.integers(0, 140, 3000)
    found = batches.span_hashes(data, starts, ends, 5)
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    by_hash = {}
    for h, span in zip(found.tolist(), spans, strict=True):
        assert by_hash.setdefault(h, span) == span
    assert len(by_hash) == len(set(spans))
    moved = batches.span_hashes(np.concatenate([data[:7], data]), starts + 7, ends + 7, 5)
    assert (moved == found).all()
