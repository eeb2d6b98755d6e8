import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bpe, knn, langid, mix, neardup, pairs, residue, split

TOKENIZERS = os.environ.get("TOKENIZERS", bpe.TOKENIZER_DIR)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/{bpe.VOCABULARY}"), reason="no vocabulary files")


# ---- 1: splitting


def test_split_round_trip(spark):
    rnd = random.Random(1)
    bits = ["a", "b", " ", "\n", "\n\n", ". ", "。", "，", "😀", "word ", "longerword", "é", "　", " ", "\r\n"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 5, 50, 300]))), rnd.choice([1, 2, 5, 10, 37, 100]), rnd.choice([0, 1, 3, 9, 36, 120])) for i in range(300)]
    rows += [(1000, None, 10, 2), (1001, "x" * 50000, 600, 120), (1002, "😀" * 3000, 1200, 200), (1003, "ab " * 100000, 600, 120), (1004, "a b", 0, -3)]
    df = spark.createDataFrame(rows, "i int, t string, s int, o int")
    for r in df.select("*", split.split_text(F.col("t"), F.col("s"), F.col("o")).alias("p")).collect():
        if r.t is None:
            assert r.p == []
            continue
        body = r.t.strip(" \t\r\n 　")
        size = max(1, r.s)
        overlap = min(max(0, r.o), size - 1)
        assert all(len(p.text) <= size and p.text == body[p.start : p.end] for p in r.p)
        assert r.p[0].start == 0 and r.p[-1].end == len(body)
        assert all(b.start == a.end - overlap and b.end > a.end for a, b in zip(r.p, r.p[1:]))


def test_split_prefers_strong_boundaries(spark):
    text = "One two. Three four.\n\nFive six seven eight. Nine ten eleven"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(split.split_text(F.col("t"), F.lit(30), F.lit(0)).alias("p")).first().p
    assert got[0].text == "One two. Three four.\n\n" and got[1].text.endswith(". ")


def test_split_settings(spark):
    rows = spark.createDataFrame([("a ", "F/x.md", None, "y" * 50, "clash"), ("b", "root.md", ["h"], "z" * 700, "clash"), ("c", None, [], None, "")], "id string, file_path string, heading_path array<string>, text string, chunk_size string")
    settings = spark.createDataFrame([("F", 20, None), ("F", None, None)], "folder string, chunk_size int, chunk_overlap int")
    got = {r.chunk_id: r.n_pieces for r in split.split_chunks(rows, settings).collect()}
    assert got["a"] > 2 and got["b"] == 2 and "c" not in got


# ---- 2: languages

SENTENCES = {
    "en": "The old map of the garden was moved to another folder because nobody needed it",
    "de": "Die alte Karte vom Garten wurde in einen anderen Ordner verschoben weil niemand sie brauchte",
    "fr": "La vieille carte du jardin a été déplacée dans un autre dossier parce que personne ne la voulait",
    "es": "El viejo mapa del jardín fue movido a otra carpeta porque nadie lo necesitaba entonces",
    "pt": "O velho mapa do jardim foi levado para outra pasta porque ninguém precisava dele então",
    "zh": "花园的旧地图被移到另一个文件夹因为没有人需要它",
}


@pytest.fixture(scope="module")
def model():
    return langid.Model.counted([(k, v + ".") for k, v in SENTENCES.items() for _ in range(5)], langid.LANGUAGES)


def test_languages(spark, model):
    rows = [(k, "xx", v + ".") for k, v in SENTENCES.items()]
    rows += [("mixed", "en", f"{SENTENCES['en']}.\n{SENTENCES['fr']}."), ("quote", "en", f"{SENTENCES['en']} (\"carte du jardin\").")]
    rows += [("code", "en-GB", f"{SENTENCES['en']}.\n```\n{SENTENCES['de']}.\n```\n# {SENTENCES['fr']}"), ("null", None, None), ("empty", "", "")]
    df = spark.createDataFrame(rows, "key string, label string, text string")
    got = {r.key: r for r in langid.languages(df, model).collect()}
    assert all(got[k].lang == k and got[k].confidence > 0.9 for k in SENTENCES)
    assert sorted(got["mixed"].langs) == ["en", "fr"] and got["quote"].langs == ["en"] and got["code"].langs == ["en"]
    assert got["null"].lang is None and got["empty"].langs == []
    cases = {(r.key, r.lang) for r in langid.mislabelled(langid.languages(df, model)).collect()}
    assert {("mixed", "en"), ("mixed", "fr"), ("de", "de")} <= cases and not any(k in ("code", "quote", "null") for k, _ in cases)
    parts = langid.segments(df.filter("key = 'mixed'"), model).orderBy("segment").collect()
    text = rows[6][2]
    assert [p.lang for p in parts] == ["en", "fr"] and parts[0].start == 0 and parts[0].end == parts[1].start and parts[1].end == len(text)


def test_backoff_to_ngrams(model):
    v, known, weak = model.vector("verschobener")
    assert model.languages[int(np.argmax(v))] == "de" and not known and not weak
    assert model.vector("ж" * 50_000)[1:] == (0.0, 1.0)


def test_confidence_and_unknown_languages(spark):
    rnd = random.Random(3)
    words = {k: (list(v) if k == "zh" else v.split()) for k, v in SENTENCES.items()}
    rows = [(f"{k}{i}", k if i % 20 else "en", ("" if k == "zh" else " ").join(rnd.choice(words[k]) for _ in range(12)) + ".") for k in SENTENCES for i in range(60)]
    df = spark.createDataFrame(rows, "key string, label string, text string")
    model = langid.fit([df])
    foreign = {
        "it": "Questa vecchia mappa degli orti venne messa altrove poiché nessuno ne aveva più bisogno.", "nl": "Deze oude kaart van de tuin werd verplaatst naar een andere map omdat niemand hem nodig had.",
        "ru": "Старая карта сада была перенесена в другую папку, потому что она никому не нужна.", "ja": "このノートはとてもながいのでべつのフォルダーにうつしました。",
    }
    who = langid.Identifier(model)
    assert all(who.records([t])[0][0] == langid.UNKNOWN for t in foreign.values())
    long, short, mixed = who.records([SENTENCES["de"] + ".", "carta", f"{SENTENCES['en']}.\n{SENTENCES['fr']}."])
    assert long[0] == "de" and short[1] < long[1] <= 1 and mixed[1] < 0.7
    asked = spark.createDataFrame([(k, "ru", t) for k, t in foreign.items()], "key string, label string, text string")
    assert langid.mislabelled(langid.languages(asked, model)).count() == 0
    assert {r.lang for r in langid.languages(asked, model).collect()} == {"und"}


# ---- 3: pairs


def test_pairing(spark):
    rows = [(1, 1, 10, "User ", "q1"), (1, 2, 11, "ASSISTANT", "a1"), (1, 2, 11, "ASSISTANT", "a1"), (1, 3, 12, "user", "q2"), (1, 4, 13, "system", "x"), (1, 5, 14, "assistant", "a2"), (1, 6, 15, "user", "q3"), (1, 7, 16, "user", "q4"), (2, 1, 20, "assistant", "hi"), (None, 1, 30, "user", "n")]
    rows += [(3, i, 100 + i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(0, 3000)]
    rows += [(4, 510, 9000, "user", "far"), (4, 5000, 9001, "assistant", "away")]
    df = spark.createDataFrame(rows, "conv_id long, seq int, msg_id long, role string, text string")
    got = {(r.question_id, r.answer_id) for r in pairs.question_answer_pairs(df).collect()}
    assert got == {(10, 11), (12, 14), (9000, 9001)} | {(100 + i, 101 + i) for i in range(0, 3000, 2)}
    assert pairs.question_answer_pairs(df.limit(0)).count() == 0


def test_defects(spark, model):
    rnd = random.Random(2)
    langs = list(SENTENCES)
    words = {k: (list(v) if k == "zh" else v.split()) for k, v in SENTENCES.items()}

    def say(lang, n):
        stop = "。" if lang == "zh" else "."
        return ("" if lang == "zh" else " ").join(rnd.choice(words[lang]) for _ in range(n)) + stop

    sound = [(say(k, 9)[:-1] + "?", say(k, 14) + (" " if k != "zh" else "") + say(k, 12)) for k in langs for _ in range(60)]
    clf = pairs.train(sound, model)
    q = SENTENCES["en"] + "?"
    cases = [(1, "", "empty"), (2, None, "empty"), (3, "- \n- ", "empty"), (4, q.upper(), "copy"), (5, "I'm sorry, but I can't help with that request.", "refusal"), (6, SENTENCES["de"] + ". " + SENTENCES["de"] + ".", "wrong_language"), (7, SENTENCES["en"] + ". The old map of the gar", "truncated"), (8, SENTENCES["en"] + ". " + SENTENCES["en"] + ".", None)]
    df = spark.createDataFrame([(i, 100 + i, q, a) for i, a, _ in cases], "question_id long, answer_id long, question string, answer string")
    got = {r.question_id: r.defect for r in pairs.defects(df, clf).collect()}
    assert got == {i: d for i, _, d in cases if d}


# ---- 4: near duplicates


def brute_pairs(rows, words, t, least):
    sets = {}
    for key, text in rows:
        w = neardup._WORD.findall((text or "").lower())
        if len(w) >= max(least, words):
            sets[key] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([45, 60, 150, 300, 700]))]
        rows.append((f"k{i:03}", " ".join(base)))
        for j in range(rnd.randrange(0, 4)):
            new = [rnd.choice(vocab) if rnd.random() < rnd.choice([0, 0.02, 0.08, 0.2]) else w for w in base]
            rows.append((f"k{i:03}-{j}", " ".join(new)))
    rows += [("han1", "旧地图" * 20), ("han2", "旧地图" * 21), ("short", "a b c"), ("null", None), ("k000", rows[0][1])]
    df = spark.createDataFrame(rows, "key string, text string")
    near = neardup.NearDuplicates(df)
    got = {(r.a, r.b) for r in near.key_pairs().collect()}
    assert got == brute_pairs(dict(rows).items(), 3, 0.5, 40)
    groups = {r.key: r.group for r in near.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and len(groups) == len({k for k, _ in rows if k not in ("short", "null")})


def test_many_copies_make_a_star(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(f"c{i:03}", text) for i in range(80)] + [("other", text + " x y z")], "key string, text string")
    near = neardup.NearDuplicates(df)
    assert {(r.a, r.b) for r in near.key_pairs().collect()} == {("c000", f"c{i:03}") for i in range(1, 80)} | {("c000", "other")}
    assert near.key_pairs(None).count() == 81 * 80 // 2
    assert neardup.NearDuplicates(df.limit(0)).key_pairs().count() == 0


def test_ngrams_in_every_record(spark):
    rnd = random.Random(8)
    rows = [(f"k{i:03}", "to be continued " + " ".join(rnd.choice("abcdef") for _ in range(rnd.choice([40, 60, 90])))) for i in range(160)]
    rows += [(f"x{i}", rows[i][1] + " z z") for i in range(5)]
    df = spark.createDataFrame(rows, "key string, text string")
    # few words, so that nearly every n-gram is hot and its postings are salted
    near = neardup.NearDuplicates(df, hot=10)
    assert {(r.a, r.b) for r in near.key_pairs().collect()} == brute_pairs(rows, 3, 0.5, 40)


# ---- 5: vectors


def _truth(x, keys, k):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(y @ y.T, 9)
    np.fill_diagonal(s, -2)
    order = np.argsort(keys)
    return {keys[i]: [keys[j] for j in order[np.argsort(-s[i][order], kind="stable")][:k]] for i in range(len(keys))}


def _found(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.key, r.rank)):
        got.setdefault(r.key, []).append(r.neighbour)
    return got


def test_exact_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_AIM", 60)
    monkeypatch.setattr(knn, "SHARD_MOST", 40)
    monkeypatch.setattr(knn, "SHARD_QUERIES", 100)
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([centres[rng.integers(0, 6, 700)] + 0.05 * rng.normal(size=(700, 16)), rng.normal(size=(20, 16)) * 9])
    x[50:62] = x[50]  # ties, and more equal vectors than can be results
    keys = [f"v{i:03}" for i in range(len(x))]
    rows = [(f" {key}\t", [float(c) for c in v], None, "clash") for key, v in zip(keys, x)]
    rows += [("zero", [0.0] * 16, None, ""), ("short", [1.0], None, ""), ("nan", [float("nan")] * 16, None, ""), ("none", None, None, ""), ("hole", [1.0] * 15 + [None], None, ""), (" ", [1.0] * 16, None, ""), (None, [1.0] * 16, None, "")]
    rows += rows[:30] + [("v001", [1.0] * 16, 5, ""), ("v001", [float(c) for c in x[1]], 9, ""), ("v002", [float("inf")] * 16, 3, "")]
    x = np.delete(x, 2, axis=0)  # the latest row of v002 is of no use
    keys.remove("v002")
    df = spark.createDataFrame(rows, "id string, vec array<double>, at long, unit string").withColumn("at", F.timestamp_millis("at"))
    for most in (200_000, 0):
        units = knn.unit_rows(knn.usable_vectors(df, "id", "vec", "at", 16, most))
        assert {r.key for r in units.collect()} == set(keys)
        truth = _truth(x, keys, 3)
        assert _found(knn.nearest(units, units, 3, relax=1.0, most_broadcast=most)) == truth
    some = units.filter("key like '%7'")
    assert _found(knn.nearest(some, units, 3, relax=1.0)) == {k: v for k, v in truth.items() if k.endswith("7")}
    relaxed = _found(knn.nearest(units, units, 3))
    assert all(len(v) == 3 for v in relaxed.values()) and set(relaxed) == set(keys)
    assert sum(len(set(relaxed[k]) & set(truth[k])) for k in truth) / (3 * len(keys)) >= 0.9
    assert knn.nearest(units.limit(0), units, 3).count() == 0
    assert knn.nearest(units, units.limit(0), 3).count() == 0
    few = units.filter("key < 'v001z'")
    assert _found(knn.nearest(few, few, 3)) == {"v000": ["v001"], "v001": ["v000"]}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {k: [n for n in v if y[keys.index(k)] @ y[keys.index(n)] >= 0.99] for k, v in truth.items()}
    mutual = {(a, b) for a in keys for b in best[a] if a < b and a in best[b]}
    assert {(r.a, r.b) for r in knn.mutual_pairs(units, 3, 0.99, relax=1.0).collect()} == mutual


# ---- 7, 8: tokens and mixing


@needs_vocabulary
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{TOKENIZERS}/{bpe.VOCABULARY}")
    reference.encode_special_tokens = True
    texts = ["", None, "Hello world's  \n\n end", "<|endoftext|>", "一二三四五六七八九十" * 40, "ａｂｃ ｶﾀｶﾅ 한국어 ​x﻿", "a" * 4000, "😀👩‍🌾" * 30, "\x00\x07 12,5e3"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(rows, tokenizer_dir=TOKENIZERS).collect()}
    own = bpe.encoder(f"{TOKENIZERS}/{bpe.VOCABULARY}")
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids
        assert own.decode(got[i]) == (t or "")
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(rows, ["doc_id"], tokenizer_dir=TOKENIZERS).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_mix(spark):
    rows = [(i, "big", 10, (i * 2654435761) % (1 << 36)) for i in range(3000)] + [(10_000 + i, "small", 10, i << 30) for i in range(10)] + [(99_999, "nobody", 5, 1), (99_998, "blank", 0, 1)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, spot long")
    targets = spark.createDataFrame([(" Big", 0.6, 1), ("small", 0.2, 4), ("missing", 0.1, 2), ("blank", 0.1, 1), (None, None, None)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mix.shares(sized, targets).collect()}
    # shares of what is at hand: 0.75 and 0.25; the small source limits the mix to 4 x 100 / 0.25 = 1600 tokens
    assert got["small"].mix_tokens == 400 and got["small"].least_repeats == 4
    assert abs(got["big"].mix_tokens - 1200) <= 10 and abs(got["big"].actual_share - 0.75) < 0.01
    assert got["missing"].actual_share == 0 and got["blank"].mix_tokens == 0
    chosen = {r.doc_id: r.repeats for r in mix.mix(sized, targets).collect()}
    assert 99_999 not in chosen and max(chosen.values()) == 4
    more = {r.doc_id for r in mix.mix(sized, targets, 4000).collect()}
    assert set(chosen) <= more
    assert mix.shares(sized.limit(0), targets).filter("actual_share > 0").count() == 0


# ---- 9: residue


def test_residue(spark):
    note = "The weekly review lists the tools that should stay together on page 12. We moved the questions to another file."
    cases = [
        ("{{title}}\n\n" + note, "placeholder"), ("# [Insert summary here]\n- ", "placeholder"), ("<Ihr Name>\n\n" + note, "placeholder"), ("【日期待填】" + note, "placeholder"),
        ("```\n{{title}}\n```\n" + note, None), ("`{{title}}`: " + note, None), ("$$\\frac{{a_1}}{{b}}$$\n" + note, None), ("See [[LINK]] and [x] done. " + note, None),
        ("Menu\nHome\nLogin\n\n404 - page not found\n\n© Abc", "error_page"), ("Zugriff verweigert: fehlende Berechtigung", "error_page"), ("[fetch] status=500 reason=gone", "error_page"),
        ('Abc 12: "Internal server error (500)" — ' + note, None), (note + "\nIt took 404 minutes.", None),
        ("Please enable JavaScript to view this page.", "script_notice"), ("<noscript>Votre navigateur bloque les scripts, le contenu ne peut pas être affiché.</noscript>\n[A](note://b)", "script_notice"),
        ("Text goes here. " * 12, "filler"), ("测" * 80, "filler"), ("- TODO\n- ???\n- foo\n- ...", "filler"), ("Lorem ipsum dolor sit amet consectetur elit sed tempor", "filler"), ("-" * 90, "filler"),
        (note, None), ("Short note.", None), ("", None), (None, None), (" \n", None),
    ]
    df = spark.createDataFrame([(i, t, "web ", "clash") for i, (t, _) in enumerate(cases)], "doc_id long, text string, source string, kind string")
    got = {r.doc_id: r.kind for r in residue.residues(df).collect()}
    assert got == {i: k for i, (_, k) in enumerate(cases) if k}
    kept = residue.without_residue(df).count()
    assert kept == len(cases) - len(got)
    assert residue.residues(df.limit(0)).count() == 0


def test_residue_comes_from_what_the_host_leaves(spark, monkeypatch):
    note = "The weekly review lists the tools that should stay together and it was moved by the others"
    frame = "Start page\nAll of our notes\nSign in here\n\n{}\n\nImprint and contact\nTerms of use"
    filler = "- ???\n- foo\n- ...\n- TODO"
    rows = [(i, frame.format(f"{note} {i}, and number {i * 7} of the {i}."), "a") for i in range(20)]
    rows += [(100, frame.format("Zugriff verweigert"), "a"), (101, frame.format(filler), "A "), (102, frame.format("0" * 120), "a"), (103, frame.format("0" * 120), "a"), (104, frame.format("0" * 120), "a")]
    rows += [(105, frame.format("Zugriff verweigert"), "b"), (106, "Zugriff verweigert", None), (107, "Mirum tolva sidra penna. " + "Tolva penna mirum sidra korda felum. " * 4, "b")]
    rows += [(108, "- Anna\n- Bert\n- Carla\n- Dora\n- Emil\n- Frida\n- Gustav\n- Hanna\n- Igor\n- Jana\n- Karl\n- Lena\n- Max", "b"), (109, "word " * 30000, "b"), (110, ("The note of the day. " * 3 + "\n") * 3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = {100: "error_page", 101: "filler", 102: "filler", 103: "filler", 104: "filler", 106: "error_page", 107: "filler", 109: "filler"}
    got = {r.doc_id: r.kind for r in residue.residues(df).collect()}
    assert {k: v for k, v in got.items() if k != 110} == expected
    # the way for more recurrent lines than may be broadcast gives the same
    assert {r.doc_id: r.kind for r in residue.residues(df, most_broadcast=0).collect()} == got
    counted = residue.boilerplate
    monkeypatch.setattr(residue, "boilerplate", lambda rows, hosts: counted(rows, hosts).limit(0))
    without = {r.doc_id for r in residue.residues(df).collect()}
    assert not without & {100, 101} and {106, 107, 109} <= without
