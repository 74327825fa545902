import math
import random

import pyarrow as pa

from epochloom.llm import quality as q

WORDS = {"the", "what", "old", "ferry", "opens", "quiet", "house", "near", "station", "we", "see", "it", "and", "then", "go", "home", "red", "blue", "lamp", "door", "night", "nurse"}
PROSE = ["The old ferry opens the quiet house.", "We see it and then go home!\nThe old ferry opens near the station.", "- We see it.\n- Then we go home.", "It", "What happ…", "We panneau…", "Thé óld férry opéns it.", "The old ferry op", "The red lamp\n\nThe old ferry opens the door. We see it.\n\n- the lamp\n\n- the door\n\nThen we go home. We see the night nurse."]
LISTS = ["- the old ferry\n- the red lamp\n- the blue door\n- the house", "the old ferry\nthe red lamp\nthe blue door\nthe house", "The house:\n1. The red lamp (3)\n2. The door (4)\n3. The ferry (6)", "[x] the lamp x3\n[ ] the door x4\n[x] the ferry x5"]
TABLES = ["the lamp;3.5;2\nthe door;1;7.25\nthe ferry;9;1", "| | kg | no. |\n|---|---|---|\n| the lamp | 3 | 4 |\n| the door | 5 | 6.1 |", "item,kg\nthe lamp,3.5\nthe door,7", "the lamp      3.5    2\nthe door      1      7", "lamp\t1\t2\ndoor\t3\t4\nhouse\t5\t6"]
JUNK = ["#$%/ &*(@ !!~ ^^ %$#@ ++", "xkqzw pqrtz bbnmw zzkrt qqwpl", "aaaaaaaaaaaaaaaa\n----------------", "00000000  93 8a 1b e3 4a\n00000010  93 e8 3e a1 09", '{"ke":13,"qi":[19,62]};{"qi":5225}', '<div id="a1"></nav><br class="q9"></div>']


def readable(text):
    """The share of a text's letters that belong to known words, as the operator counts it."""
    words = q.words_of(q.clean(pa.array([text])))
    stats = {k: float(v[0]) for k, v in q._plain_statistics(q.clean(pa.array([text])), words).items()}
    names = words.distinct.to_pylist()
    own = [names[c] for c in words.code]
    cut = len(own[-1]) if own and own[-1] not in WORDS and len(own[-1]) <= q.LONGEST_WORD else 0
    judged = stats["n_dense"] - (cut + stats["dots"] if cut else 0)
    return min(1.0, sum(len(w) for w in own if w in WORDS) / judged) if judged > 0 else 1.0


def test_kinds():
    for texts, wanted in ((PROSE, None), (LISTS, "list"), (TABLES, "table"), (JUNK, "junk")):
        for text in texts:
            assert q.kind_of(text, readable(text)) == wanted, text


def test_words():
    def of(text):
        w = q.words_of(q.clean(pa.array([text])))
        return [w.distinct[c].as_py() for c in w.code]

    assert of("a\u200bb ＡＢ") == ["ab", "ab"]
    assert of("東京 Ab1c <b>x</b>") == ["東", "京", "ab", "c", "x"]
    assert of("ガéñ") == ["カ", "en"] and of("\ud55c\uad6d x") == ["\ud55c\uad6d", "x"]
    assert of(None) == of("") == of(" \n.") == []


def corpus(spark):
    rng = random.Random(4)
    words = sorted(WORDS - {"it"})
    prose = [" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." + ("\n" + " ".join(rng.choice(words) for _ in range(7)) + "!" if i % 2 else "") for i in range(200)]
    texts = [*prose, *LISTS, *TABLES, *[j for j in JUNK if "div" not in j], None, "", " \n ", "x"]
    rows = [(i, ["en", "de", None][i % 3], t, "s") for i, t in enumerate(texts)] + [(0, "en", prose[0], "s"), (None, "en", LISTS[0], "s")]
    return rows, spark.createDataFrame(rows, "doc_id long, lang string, text string, row string")


def test_exact_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice("st"), rng.choice(["en", None]), rng.choice([0.0, 0.0, 0.0, round(rng.random(), 1), None])) for _ in range(900)]
    out = q.exact_ranks(q.counted_values(spark.createDataFrame(rows, "statistic string, lang string, value double"))).collect()
    assert len(out) == len({(s, lang, v) for s, lang, v in rows if v is not None})
    for r in out:
        every = [v for s, _, v in rows if s == r["statistic"] and v is not None]
        own = [v for s, lang, v in rows if s == r["statistic"] and lang == r["lang"] and v is not None]
        assert (r["n_below"], r["n_equal"], r["n_total"]) == (sum(v < r["value"] for v in own), own.count(r["value"]), len(own))
        assert (r["all_below"], r["all_equal"], r["all_total"]) == (sum(v < r["value"] for v in every), every.count(r["value"]), len(every))


def test_scores(spark):
    rows, df = corpus(spark)
    scored = q.outlier_scores(q.document_statistics(df)).collect()
    assert len(scored) == len(rows)
    for r in scored:
        if r["n_words"] is None:
            assert r["score"] == 0 and not (dict((i, t) for i, _, t, _ in rows)[r["doc_id"]] or "").strip()
            continue
        total = 0.0
        for name, direction in q.STATISTICS.items():
            every = [x[name] for x in scored if x["n_words"] is not None]
            own = [x[name] for x in scored if x["n_words"] is not None and x["lang"] == r["lang"]]
            tails = [(sum(map(f, own)) + q.PRIOR_DOCUMENTS * sum(map(f, every)) / len(every)) / (len(own) + q.PRIOR_DOCUMENTS) for f in (lambda v: v <= r[name], lambda v: v >= r[name])]  # noqa: B023
            total += math.log(tails[0] if direction == "low" else tails[1] if direction == "high" else min(1.0, 2 * min(tails))) ** 2
        assert abs(total - r["score"]) < 1e-9


def test_found(spark):
    rows, df = corpus(spark)
    scored = q.outlier_scores(q.document_statistics(df))
    want = {i: k for i, t, k in [*((i, t, "list") for i, _, t, _ in rows if t in LISTS), *((i, t, "table") for i, _, t, _ in rows if t in TABLES), *((i, t, "junk") for i, _, t, _ in rows if t in JUNK)]}
    got = q.judge(scored, df).collect()
    assert len(got) == len({r["doc_id"] for r in got})
    found = {r["doc_id"]: r["kind"] for r in got}
    assert all(want.get(i) == k for i, k in found.items()), found
    assert len(found) >= 0.9 * len(want) and None in found
    # The score decides: with a threshold that nothing reaches no document is judged, and without one more are than needed.
    assert q.judge(scored, df, suspect=1e9).count() == 0
    assert scored.where(f"score >= {q.SUSPECT}").count() < 0.4 * len(rows)


def test_join_in_place_of_broadcast_gives_the_same(spark):
    _, df = corpus(spark)
    one = sorted(map(tuple, q.document_statistics(df).collect()), key=repr)
    assert one == sorted(map(tuple, q.document_statistics(df, most_broadcast=0).collect()), key=repr)


def test_copies_of_one_text_make_no_word_common(spark):
    df = spark.createDataFrame([(i, "en", "zzkrt qqwpl zzkrt") for i in range(30)] + [(90, "en", "red lamp"), (91, "en", "red door")], "doc_id long, lang string, text string")
    assert {r["word"] for r in q.common_words(df).collect()} == {"red"}


def test_long_text_and_empty_table(spark):
    long = "the old ferry opens. " * 60_000
    df = spark.createDataFrame([(1, "en", long), (2, "en", "the old lamp.")], "doc_id long, lang string, text string")
    assert {r["doc_id"]: r["n_words"] for r in q.document_statistics(df).collect()} == {1: 240_000, 2: 3}
    assert q.judge(q.outlier_scores(q.document_statistics(df.limit(0))), df.limit(0)).count() == 0
