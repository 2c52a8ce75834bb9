"""The operators against brute force, SQL or the library itself, and their defined cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, decontaminate, line_dedup, lm_scoring, mixing, near_dedup, permutation_index, queries, substring_dedup, token_counts, toxicity, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, row string, n_lines int, size string, score string, `odd name` string, key string, id string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with inner and result columns."""
    return spark.createDataFrame([(i, t, s, "r", 7, "s", "x", "o", "k", "i") for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "b"), (3, " \t\n\n ", None), (None, "one two three", "a"), (None, None, None), (4, "x", "b"), (4, "x", "b"), (5, "wörd " * 30_000, "a"), (6, "a\x00b   \U0001f600", "")]


def texts_of(spark, sf=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def duck(sql, spark_free_tables):
    import duckdb

    con = duckdb.connect()
    for name, path in spark_free_tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck(queries.SQL[name], {t: f"{SF}/{t}.parquet" for t in ("documents", "conversations")})
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns)
    assert [re.sub(r"np\.\w+\(([^)]*)\)", r"\1", x) for x in rows(got)] == [re.sub(r"np\.\w+\(([^)]*)\)", r"\1", x) for x in rows(want)]


# ---- words ------------------------------------------------------------------------------------------------------------


def test_words_and_grams():
    texts = ["  a bb\tCC\n", None, "", "é \x0b \x85x", "a bb"]
    w = words.split(pa.array(texts), lower=True)
    own = [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert own == [["a", "bb", "cc"], [], [], ["é", "\x85x"], ["a", "bb"]]
    h = w.hashes()
    assert h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
    g = words.Grams(h)
    assert g.of(np.array([0]), np.array([2])) == g.of(np.array([5]), np.array([7])) != g.of(np.array([1]), np.array([3]))
    assert words.window_starts(w.first, 2).tolist() == [0, 1, 3, 5]
    assert [r for r in words.slices(pa.array(["x" * 9, None, "y" * 9, "z"]), 10)] == [(0, 2), (2, 4)]


# ---- 1 ----------------------------------------------------------------------------------------------------------------


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_leaks_same_as_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 20
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 3 == 0:
            part = tokens(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(part) // 5)):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randint(0, len(own))
            own[at:at] = part
        docs.append((d, " ".join(own).upper() if d % 2 else " \n ".join(own)))
    want = {(d, i): k for d, t in docs for i, x in items if (k := edit_distance_in(tokens(lower(x)), tokens(lower(t)))) <= len(tokens(x)) // 5}
    got = decontaminate.find_leaks(docs_of(spark, [(*x, "s") for x in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(want) > 10
    text = dict(docs)
    for r in got:
        part = tokens(lower(text[r["doc_id"]]))[r["first_word"] : r["first_word"] + r["n_words"]]
        assert edit_distance_in(tokens(lower(dict(items)[r["item_id"]])), part) == r["distance"]


def test_leak_recall_at_the_threshold():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(1))}" for _ in range(4000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 55))) for _ in range(300)]
    made = decontaminate.Items(list(range(300)), items, 0.8)
    texts = []
    for x in items:
        part = x.split()
        for _ in range(len(part) // 5):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = ["zz"] * rng.randint(0, 1)
        texts.append(" ".join(rng.choices(vocabulary, k=30) + part + rng.choices(vocabulary, k=30)))
    w = words.split(pa.array(texts), lower=True)
    found = {(d, i) for d, i, *_ in decontaminate.matches(w.hashes(), w.first, made)}
    want = {(d, d) for d in range(300) if edit_distance_in(items[d].split(), texts[d].split()) <= len(items[d].split()) // 5}
    assert len(found & want) >= 0.99 * len(want)


@pytest.mark.parametrize("n", [*range(5, 21), 30, 45, 60])
def test_leak_recall_by_length(n):
    """At the threshold: the first word edited, the last one, and as many random ones as the threshold allows."""
    rng = random.Random(n)
    vocabulary = [f"w{int(rng.paretovariate(1))}" for _ in range(4000)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for _ in range(30)]
    made = decontaminate.Items(list(range(30)), items, 0.8)
    for kind in ("first", "last", "random"):
        texts = []
        for x in items:
            part = x.split()
            if kind == "first":
                part[:1] = ["zz"] * rng.randint(0, 1)
            if kind == "last":
                part[-1:] = ["zz"] * rng.randint(0, 1)
            for _ in range(n // 5 if kind == "random" else n // 5 - 1):
                k = rng.randrange(len(part))
                part[k : k + rng.randint(0, 1)] = ["zz"] * rng.randint(0, 1)
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + part + rng.choices(vocabulary, k=rng.randint(0, 30))))
        w = words.split(pa.array(texts), lower=True)
        found = {(d, i): k for d, i, _, _, k in decontaminate.matches(w.hashes(), w.first, made)}
        want = {(d, i): k for d, t in enumerate(texts) for i, x in enumerate(items) if (k := edit_distance_in(x.split(), t.split())) <= n // 5}
        assert len(want) >= 30 and (found == want if n < 15 else len(found) >= 0.97 * len(want))


def test_leak_cases(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, None), (3, "one two"), (4, ""), (5, "alpha beta gamma delta epsilon"), (None, "zeta eta theta iota kappa")], "item_id long, text string")
    docs = docs_of(spark, [*EDGE, (7, "x Alpha BETA gamma delta epsilon", "a"), (None, "zeta eta theta iota kappa", "a")])
    got = decontaminate.find_leaks(docs, bench)
    assert sorted(map(str, ((r["doc_id"], r["item_id"], r["first_word"], r["n_words"], r["distance"]) for r in got.collect()))) == ["(7, 1, 1, 5, 0)", "(7, 5, 1, 5, 0)", "(None, None, 0, 5, 0)"]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(EDGE)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 == decontaminate.find_leaks(docs, bench.limit(0)).count()


def test_leaks_of_items_of_one_to_four_words(spark):
    bench = spark.createDataFrame([(1, "Alpha"), (2, "one two"), (3, "a b c"), (4, "p q r s"), (5, " "), (6, None)], "item_id long, text string")
    docs = docs_of(spark, [(1, "x ALPHA one\ttwo one two", "s"), (2, "one three two alphas a b", "s"), (3, "c a b c p q r s", "s"), (4, "p q r", "s"), (5, None, "s")])
    got = decontaminate.find_leaks(docs, bench, min_words=1).collect()
    assert sorted(tuple(r)[:5] for r in got) == [(1, 1, 1, 1, 0), (1, 2, 2, 2, 0), (3, 3, 1, 3, 0), (3, 4, 4, 4, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench, min_words=1).collect()) == [2, 4, 5]


# ---- 2 ----------------------------------------------------------------------------------------------------------------


def test_chats(spark):
    a, b, c = ("user", "hi"), ("assistant", "<|end|> <| ho\n"), ("user", None)
    logged = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, (None, "")], 6: [a, (None, None)], 7: [c], None: [b, b]}
    rows = [(k, i, *t, "extra") for k, turns in logged.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")).collect()}
    assert set(got) == {3, 5, 6, 7, None} and got[3]["n_equal"] == 2 and got[3]["n_turns"] == 3
    assert chat.parse(got[3]["rendered"]) == [("user", "hi"), ("assistant", "<|end|> <| ho\n"), ("user", "")]
    assert chat.parse(got[5]["rendered"]) == [("user", "hi"), ("none", "")]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------------------------------


def test_line_cases(spark):
    line = "A repeated line of more than twenty"
    docs = docs_of(spark, [*EDGE, (10, f"{line}\nx", "a"), (11, f"  {line.upper()}\t\ny\n{line}", "a"), (12, f"z\n{line}\r\n{line}", "a"), (None, f"{line}\nq", "a"), (12, "again\n" + line, "b")])
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    by = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"], r["row"]) for r in got.collect()}
    assert by[10, "x"] == (2, 1, "r") and by[11, "y"] == (3, 2, "r") and by[None, "q"] == (2, 1, "r")
    assert by[12, f"z\n{line}\r\n{line}"] == (3, 0, "r") and by[12, "again\n" + line] == (2, 0, "r") and by[1, ""] == (1, 0, "r") and by[3, " \t\n\n "] == (3, 0, "r")
    assert got.count() == docs.count() and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_two_documents_keep_their_line(spark):
    docs = docs_of(spark, [(1, "the very same line, which is long", "a"), (2, "the very same line, which is long", "a")])
    assert line_dedup.dedup_lines(docs).agg(F.sum("n_dropped")).first()[0] == 0


# ---- 4 ----------------------------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=400):
    rng = random.Random(11)
    clean = ["".join(rng.choices(["an", "to", "re", "li", "mo", "sa", "en"], k=rng.randint(1, 4))) for _ in range(400)]
    bad = ["dreckig", "vermin", "wretched"]
    rows, labels = [], []
    for i in range(n):
        own = rng.choices(clean, k=rng.randint(10, 60))
        if i % 5 == 0:
            for w in rng.choices(bad, k=3):
                own.insert(rng.randrange(len(own)), w)
        rows.append((i, " ".join(own), "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_restores_and_scores(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    channel = toxicity.Channel(model[0])
    assert channel.restore("v3rm1n") == "vermin" and channel.restore("wr3tch3d") == "wretched" and channel.restore("v e r m i n") == "vermin" and channel.restore("verrrrmin") == "vermin"
    probe = docs_of(spark, [*EDGE, (100, "to anre v3rm1n sali dr3ck1g en", "a"), (101, "to anre v e r m i n sali w r e t c h e d", "a"), (102, "to anre sali en toli", "a"), (103, "VERMIN!!! anre Wretched.", "a")])
    got = toxicity.score_toxicity(probe, model)
    assert [c for c in got.columns if c not in ("score", "predicted")] == [c for c in probe.columns if c != "score"]
    by = {r["doc_id"]: r for r in got.where("doc_id >= 100").collect()}
    assert [by[i]["predicted"] for i in (100, 101, 102, 103)] == [1, 1, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in got.collect()) and got.count() == probe.count() and got.where("doc_id < 100 AND predicted = 1").count() == 0
    text = {r["doc_id"]: r["text"] for r in toxicity.deobfuscate(probe, model[0]).collect()}
    assert text[100] == "to anre vermin sali dreckig en" and text[1] is None and text[102] == "to anre sali en toli"
    kept = toxicity.drop_toxic(probe, model)
    assert kept.columns == probe.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 6, None, 102}


def brute_restore(channel, token):
    """The best of all ways to read a token, one by one."""
    ways = []
    for i, c in enumerate(token):
        arcs = [(c, 0.0)]
        if c == " ":
            arcs = [("", toxicity.JOINED), (" ", toxicity.APART)]
        elif c in toxicity.LOOKS_LIKE:
            arcs = [(c, toxicity.SAME), ("", toxicity.GONE)] + [(x, toxicity.ALIKE) for x in toxicity.LOOKS_LIKE[c]]
        elif not c.isalpha():
            arcs = [(c, toxicity.SAME), ("", toxicity.GONE)]
        elif i and c == token[i - 1]:
            arcs = [(c, 0.0), ("", toxicity.DOUBLED)]
        ways.append(arcs)

    def score(way):
        out, total = " ", 0.0
        for emitted, cost in way:
            total += cost + (channel.log(out[-3:], emitted) if emitted else 0.0)
            out += emitted
        return total + channel.log(out[-3:], " ")

    best = max(itertools.product(*ways), key=score)
    return score(best), "".join(x for x, _ in best), score


def channel_of(texts):
    counts = np.zeros((toxicity.ORDER, 1 << toxicity.TABLE_BITS), np.int64)
    toxicity.gram_counts(pa.array(texts), counts)
    return toxicity.Channel(zlib.compress(counts.tobytes(), 1))


@pytest.mark.parametrize("beam", [12, 10**6])
def test_restoring_same_as_all_ways(monkeypatch, beam):
    monkeypatch.setattr(toxicity, "BEAM", beam)
    channel = channel_of([t for _, t in [(r["doc_id"], r["text"]) for r in pa.parquet.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]])
    rng, own = random.Random(4), []
    for _ in range(60):
        word = list("".join(rng.choices("abeilostgz", k=rng.randint(3, 7))))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(word))
            word[i] = rng.choice([{"a": "4", "e": "3", "i": "1", "o": "0", "s": "$", "b": "8"}.get(word[i], word[i]), word[i] * 3, "*", "-" + word[i]])
        own.append("".join(word)[:9])
    own += ["v e r m i n", "a1b2", "aaaa", "@@@", "1", "ß5ß"]
    same = 0
    for token in own:
        want, restored, score = brute_restore(channel, token)
        same += channel.restore(token) == restored
    assert same == len(own) if beam > 12 else same >= 0.97 * len(own)


def test_long_tokens_are_decoded_as_far_as_they_count():
    channel = channel_of(["an alpine walk and a talk about alpine wolves " * 50])
    rng = random.Random(9)
    for token in ["".join(rng.choices("abcdefgh0123456789+/", k=3000)) + "xy", "a1" * 1500, "1" * 2000 + "ab", "a" + "." * 2000 + "7", "4lp1n3" * 300, "b" * 900]:
        whole, cut = toxicity.plain_words(token, channel), toxicity.plain_words(token, channel, 20)
        assert [x[:21] for x in whole] == [x[:21] for x in cut] and [len(x) > 20 for x in whole] == [len(x) > 20 for x in cut]
    began = time.time()
    toxicity.plain_words("".join(rng.choices("abcdefgh0123456789+/", k=1_000_000)) + "xy", channel, 20)
    assert time.time() - began < 5


def test_toxicity_held_out_accuracy(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.95 and held[held.toxic == 0].predicted.mean() <= 0.02 and held[held.toxic == 1].predicted.mean() >= 0.7


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, EDGE)
    labels = spark.createDataFrame([(1, None), (2, 3)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, own)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------------------------------


def weights_of(text):
    own = tokens(lower(text))
    return Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else Counter([tuple(own)] if own else [])


def probability_jaccard(x, y):
    if not x.keys() & y.keys():
        return 0.0
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in x.keys() & y.keys())


def brute_classes(rows):
    sets = [weights_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(rows, group, strict=True):
        least[g].append(i)
    return {i: min(least[g]) for (i, _), g in zip(rows, group, strict=True)}


@pytest.mark.parametrize("sizes", [{}, {"block": 3}, {"block": 2}])
def test_near_classes_same_as_brute_force(spark, sizes):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = rng.choices([f"w{k}" for k in range(200)], k=rng.randint(1, 60)) * rng.choice([1, 1, 3])
        for _ in range(rng.choice([1, 2, 6, 20])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"v{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
    got = near_dedup.near_classes(docs_of(spark, [(*r, "s") for r in rows]), **sizes).collect()
    assert {r["id"]: r["class_id"] for r in got} == brute_classes(rows)
    size = Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == size[r["class_id"]] for r in got)


def test_near_classes_compare_a_wide_family_once(spark, monkeypatch):
    """Texts that share many buckets and are all apart: tiles take rows of the family once, not of each bucket, and no link is lost."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:at] + [f"v{k}"] + base[at + 1 :])) for k, at in enumerate(random.Random(5).choices(range(4, 56), k=90))]
    tiles, real = [], near_dedup.written

    def counted(df, name):
        out = real(df, name)
        if name == "tiles":
            tiles.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_dedup.near_classes(docs_of(spark, [(*r, "s") for r in rows]), block=8).collect()
    assert {r["id"]: r["class_id"] for r in got} == brute_classes(rows)
    assert len(tiles) == 2 and tiles[1] <= 90 * 2 * -(-90 // 8)


def test_near_duplicate_query(spark):
    rows = texts_of(spark)
    assert {r["doc_id"]: r["class_id"] for r in queries.op5_near_dedup(spark, SF).collect()} == brute_classes(rows)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    x, y = {i: float(rng.integers(1, 6)) for i in range(40)}, {i: float(rng.integers(1, 6)) for i in range(15, 55)}
    pick = lambda d: (words.mix(np.array(list(d), np.uint64) + np.uint64(1)), np.array(list(d.values())))
    (hx, wx), (hy, wy) = pick(x), pick(y)
    kept = near_dedup.prob_minhash(np.concatenate([hx, hy]), np.concatenate([wx, wy]), np.repeat([0, 1], 40), 2, 4096)
    want = probability_jaccard(Counter(x), Counter(y))
    assert abs((kept[0] == kept[1]).mean() - want) < 0.03
    a, b = (hx[np.argsort(hx)], wx[np.argsort(hx)]), (hy[np.argsort(hy)], wy[np.argsort(hy)])
    assert math.isclose(near_dedup.probability_jaccard(a, b), want, rel_tol=1e-12)


def test_near_duplicate_cases(spark):
    docs = docs_of(spark, [*EDGE, (20, "a b c d e f g", "a"), (21, "A b c d e f g", "a"), (22, "a b", "a"), (23, "a  b\n", "a"), (None, "a b", "a")])
    got = near_dedup.near_duplicates(docs)
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert by[21, "A b c d e f g"]["class_id"] == 20 and not by[21, "A b c d e f g"]["kept"] and by[20, "a b c d e f g"]["kept"]
    assert {by[i, t]["class_id"] for i, t in ((22, "a b"), (23, "a  b\n"), (None, "a b"))} == {22} and by[1, None]["kept"] and by[2, ""]["kept"]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, None, None, 4, 5, 6, 20, 22])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_nearest_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), defaultdict(list)
    for r in queries.op6_nearest_vectors(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    known = {q: dict(v) for q, v in want.items()}
    assert all(math.isclose(s, known[q][i], rel_tol=1e-12) for q, v in got.items() for i, s in v if i in known[q])


def test_nearest_small_table_is_no_brute_force(spark):
    """500 vectors: the share is learned here too, and enough."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), defaultdict(set)
    for r in queries.op6_nearest_vectors(spark, "/root/testdata/sf0.01").collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def normal(rng, n, d):
    return rng.normal(size=(n, d))


def clustered(rng, n, d):
    return rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, d))


@pytest.mark.parametrize("made,d", [(normal, 8), (normal, 64), (normal, 384), (clustered, 64), (clustered, 384)])
def test_recall_with_the_learned_share(made, d):
    """One shard of 8192 rows that the share was not learned on; queries are no pivots. Only the evenly spread 384-d vectors need most rows."""
    rng = np.random.default_rng(d)
    x = made(rng, 16384 + 100, d)
    fit, rows, asked = x[:8192], x[8192:16384], x[16384:]
    longest = np.linalg.norm(x, axis=1).max()
    pivots = np.hstack([fit[:512] / longest, np.sqrt(np.maximum(0, 1 - (fit[:512] / longest) ** 2 @ np.ones((d, 1))))])
    share = permutation_index.share_for(fit, pivots, longest, 20)
    each = permutation_index.PIVOTS_EACH
    files = [permutation_index.inverted(permutation_index.nearest_pivots(y, pivots, far, each), 512) for y, far in ((asked, None), (rows, longest))]
    close = permutation_index.footrule_closeness(*files, each, len(asked), len(rows))
    best = np.argsort(-close, axis=1, kind="stable")[:, : int(np.ceil(share * len(rows)))]
    true = np.argsort(-(asked @ rows.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, true, strict=True)])
    print(made.__name__, d, round(share, 3), round(recall, 3))
    assert recall >= 0.93 and (share < 0.5 or d == 384)


def test_nearest_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (40, [-5.0, 1.0]), (40, [-5.0, 1.0]), (60, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
    own = lambda x: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in x.collect())
    got = own(permutation_index.nearest(df, lambda i: i % 20 == 0))
    assert got == [(20, 1, 1, 4.0), (20, 2, 2, 4.0), (20, 3, 40, -3.0), (40, 1, 20, -3.0), (40, 2, 1, -9.0), (40, 3, 2, -9.0)]
    assert own(permutation_index.nearest(df.limit(0), lambda i: i % 20 == 0)) == []


def test_lengths_count(spark):
    """Longer vectors win by inner product; several shards and blocks."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 5)).tolist()) for i in range(3000)]
    got = defaultdict(set)
    for r in permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, shard_rows=1500).collect():
        got[r["query_id"]].add(r["id"])
    want = brute_nearest(rows)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


# ---- 7 ----------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    own = [tokens(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeats_same_as_brute_force(spark):
    rng = random.Random(8)
    passages = [rng.choices("abcdefgh", k=rng.randint(10, 60)) for _ in range(6)] + [["a"] * 50, ["a", "b"] * 30]
    rows = []
    for d in range(80):
        own = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a, b = sorted(rng.choices(range(len(p) + 1), k=2)) if rng.random() < 0.5 else (0, len(p))
            own += p[a:b] + rng.choices("stuvwxyz", k=rng.randint(0, 30))
        rows.append((d % 70, " ".join(own) if d % 9 else "\n ".join(own)))
    rows += rows[3:5]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_repeats(rows, 12), strict=True))
    got = substring_dedup.remove_repeats(docs_of(spark, [(*r, "s") for r in rows]), window=12, seed=5).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == want
    assert sum(k[2] for k in want) > 500


def test_repeat_cases(spark):
    docs = docs_of(spark, EDGE)
    got = {(r["doc_id"], r["text"]): (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[5, ""] == (30_000, 30_000) and got[1, ""] == (0, 0) and got[4, "x"] == (1, 0) and got[None, "one two three"] == (3, 0)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------------------------------


def test_token_counts_same_as_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [(1, "Don't I'LL we've <|endoftext|>x <|startoftext|> é é İstanbul ΣΑΣ 中文字 1234 a b   x\x1cy"), (2, "ﬁ ﷺ \U0001f600\U0001f601!!??"), *((i, t) for i, t, _ in EDGE)]
    rows = [*odd, *((i + 1000, t) for i, t in texts_of(spark))]
    docs = docs_of(spark, [(*r, "s") for r in rows])
    for size in (0, 500):
        got = sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, path, table_size=size).collect())))
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in rows]
        assert got == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


# ---- 9 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most_head,most_pairs", [(0, 0), (300, 5), (1 << 19, 1 << 20)])
def test_base_scores_same_as_brute_force(spark, most_head, most_pairs):
    rows = texts_of(spark)[:60] + [(i, t) for i, t, _ in EDGE]
    got = lm_scoring.score_texts(docs_of(spark, [(*r, "s") for r in rows]), most_head=most_head, most_pairs=most_pairs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    own = {r: [*tokens(lower(r[1])), None] for r in rows}
    c = Counter(t for r in rows if not held(r[0]) for t in own[r])
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(own[i, t]), sum(c[x] > 0 for x in own[i, t]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own[i, t]), 6)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def brute_model(texts):
    """Seating and probabilities with plain loops: all customers of all dishes, one after another. Returns p(word, room)."""
    hashed = lambda x: int(words.split(pa.array([x])).hashes()[0]) if x is not None else 0
    uniform = lambda seed, k: ((mixed(seed + k * 0x9E3779B97F4A7C15) >> 11) + 0.5) * 2.0**-53

    def mixed(x):
        x &= words.MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & words.MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & words.MASK
        return x ^ x >> 31

    def tables(n, new, discount, seed):
        made = 1
        for k in range(1, n):
            made += uniform(seed, k) * (k - discount * made + new) < new
        return made if n else 0

    pairs = Counter((a, b) for t in texts for a, b in zip(["start", *t], [*t, None], strict=True))
    n1, n2 = (sum(n == k for n in pairs.values()) for k in (1, 2))
    rooms, vocabulary = defaultdict(int), {b for _, b in pairs}
    for (a, _), n in pairs.items():
        rooms[a] += n
    t, d0, states = dict.fromkeys(pairs, 1), None, []
    d1 = lm_scoring.discount_of(n1, n2)
    for sweep in range(lm_scoring.LAST + 1):
        if sweep:
            new = {p: (1 + d1 * states[-1][1][p[0]]) * states[-1][0](p[1]) for p in pairs}
            t = {p: tables(n, new[p], d1, mixed(mixed(hashed(p[1]) * int(words._GRAM) + (1 if p[0] == "start" else hashed(p[0]))) + sweep)) for p, n in pairs.items()}
        opened, served = defaultdict(int), Counter()
        for (a, b), k in t.items():
            opened[a] += k
            served[b] += k
        if not sweep:
            d0 = lm_scoring.discount_of(sum(c == 1 for c in served.values()), sum(c == 2 for c in served.values()))
            mine = {b: min(1, c) for b, c in served.items()}
        else:
            base = states[-1][2]
            mine = {b: tables(c, base, d0, mixed(hashed(b) + (sweep << 8))) for b, c in served.items()}
        base = (1 + d0 * sum(mine.values())) / (len(vocabulary) + 1)
        word = lambda b, served=served, mine=mine, base=base: (served.get(b, 0) - d0 * mine.get(b, 0) + base) / (sum(served.values()) + 1)
        states.append((word, opened, base, dict(t)))

    def probability(b, a):
        out = 0.0
        for word, opened, _, t in states[lm_scoring.BURN_IN + 1 :]:
            own = pairs.get((a, b), 0)
            out += (own - d1 * t.get((a, b), 0)) / (rooms.get(a, 0) + 1) + (1 + d1 * opened.get(a, 0)) / (rooms.get(a, 0) + 1) * word(b)
        return out / lm_scoring.SAMPLES

    return probability, vocabulary


@pytest.mark.parametrize("most_head,most_pairs", [(0, 0), (30, 4), (1 << 19, 1 << 20)])
def test_scores_same_as_plain_loops(spark, most_head, most_pairs):
    rng = random.Random(6)  # no dish has more customers than are seated one by one
    rows = [(i, " ".join(f"W{rng.choice((rng.randrange(9), rng.randrange(60)))}" for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(2, "w1 w1 w2 unheard w1 unheard"), (200, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    probability, vocabulary = brute_model([tokens(lower(t)) for i, t in rows if not held(i)])
    want = sorted((i, t or "", round(sum(math.log10(probability(b, a)) for a, b in zip(["start", *tokens(lower(t))], [*tokens(lower(t)), None], strict=True)), 4)) for i, t in rows)
    got = lm_scoring.score_texts(docs_of(spark, [(*r, "s") for r in rows]), most_head=most_head, most_pairs=most_pairs, keep=["doc_id", "text"]).collect()
    got = sorted((r["doc_id"], r["text"] or "", r["score"]) for r in got)
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 2e-4 for x, y in zip(got, want, strict=True))
    for room in ("start", "w1", "w2", "unheard"):
        assert abs(sum(probability(b, room) for b in vocabulary) + probability("nobody says this", room) - 1) < 1e-9


def test_model_beats_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_split_rooms_change_nothing(spark, monkeypatch):
    """A room with a third of all tokens, split over parts or whole."""
    rng = random.Random(7)
    rows = [(i, " ".join(x for _ in range(20) for x in ("the", f"n{int(rng.paretovariate(0.6))}"))) for i in range(120)]
    own = lambda: sorted((r["doc_id"], round(r["score"], 6)) for r in lm_scoring.score_texts(docs_of(spark, [(*r, "s") for r in rows]), most_pairs=10).collect())
    monkeypatch.setattr(lm_scoring, "HOT_SAMPLE", 1)
    split = own()
    monkeypatch.setattr(lm_scoring, "parts_of", lambda docs, text: lm_scoring.Parts(16, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert split == own()


def test_preceding_words_count(spark):
    """Two words are as frequent after each of two others, but for the order."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("a b", "c d")) for _ in range(30))) for i in range(300)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], "a b " * 20 + "c d " * 20), (held[1], "a d " * 20 + "c b " * 20)]
    got = {r["doc_id"]: r["perplexity"] for r in lm_scoring.score_texts(docs_of(spark, [(*r, "s") for r in rows])).collect()}
    assert got[held[0]] < 2 and got[held[1]] > 5 * got[held[0]]
    assert lm_scoring.BURN_IN >= 2 and lm_scoring.SAMPLES >= 3


def test_seating():
    c = np.array([0, 1, 2, 50, 5000, 10**7])
    t = lm_scoring.seat(c, np.full(6, 5.0), 0.5, words.mix(np.arange(6).astype(np.uint64)))
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all()
    many = lm_scoring.seat(np.full(4000, 200), np.full(4000, 3.0), 0.0, words.mix(np.arange(4000).astype(np.uint64)))
    assert abs(many.mean() - sum(3 / (3 + i) for i in range(200))) < 0.3


@pytest.mark.parametrize("n,new,discount", [(900, 0.4, 0.7), (900, 6.0, 0.8), (3000, 60.0, 0.5), (500, 300.0, 0.9)])
def test_seating_in_one_draw_is_as_one_by_one(monkeypatch, n, new, discount):
    """All customers with a draw each, in a plain loop; then means and spreads where waiting times are drawn."""
    seeds = words.mix(np.arange(3000).astype(np.uint64))
    plain = np.ones(50)
    for k in range(1, n):
        plain += lm_scoring._draws(seeds[:50], k) * (k - discount * plain + new) < new
    assert (lm_scoring.seat(np.full(50, n), np.full(50, new), discount, seeds[:50]) == plain).all()
    monkeypatch.setattr(lm_scoring, "MOST_ALONE", 64)
    got = lm_scoring.seat(np.full(3000, n), np.full(3000, new), discount, seeds)
    rng, made = np.random.default_rng(1), np.ones(3000)
    for k in range(1, n):
        made += rng.random(3000) * (k - discount * made + new) < new
    error = made.std() * math.sqrt(2 / 3000)
    assert abs(got.mean() - made.mean()) < 4 * error and abs(got.std() / made.std() - 1) < 0.08


def test_dishes_are_seated_together(monkeypatch):
    """As many tables as when each dish is seated alone, but with one call for many dishes."""
    rng, draws, calls = np.random.default_rng(2), lm_scoring._draws, []
    c = np.concatenate([rng.integers(0, 900, 20_000), [lm_scoring.CHUNK, lm_scoring.CHUNK + 1, 300_000]])
    new, seeds = rng.uniform(0.01, 40, len(c)), words.mix(np.arange(len(c)).astype(np.uint64))
    monkeypatch.setattr(lm_scoring, "_draws", lambda s, k: (calls.append(1), draws(s, k))[1])
    got = lm_scoring.seat(c, new, 0.6, seeds)
    assert len(calls) < 1000
    want = np.minimum(c, 1).astype(float)
    for n in range(1, lm_scoring.ONE_BY_ONE):
        on = c > n
        want[on] += draws(seeds[on], n) * (n - 0.6 * want[on] + new[on]) < new[on]
    for i in np.flatnonzero(c > lm_scoring.ONE_BY_ONE):
        want[i] = lm_scoring._seated_alone(want[i], int(c[i]), float(new[i]), 0.6, seeds[i])
    assert (got == want).all()


@pytest.mark.parametrize("n,spread", [(0, True), (1, True), (2, True), (5000, True), (3000, False)])
def test_places_of_hashes(n, spread):
    """Also where many hashes have their first bits in common."""
    own = words.mix(np.arange(n).astype(np.uint64)) if spread else np.arange(n).astype(np.uint64) * np.uint64(3)
    own = np.unique(np.concatenate([own, np.array([0, 1, words.MASK][:n], np.uint64)]))
    asked = np.concatenate([own, own + np.uint64(1), words.mix(np.arange(10_000, 20_000).astype(np.uint64)), np.array([0, words.MASK], np.uint64)])
    at = {int(x): i for i, x in enumerate(own)}
    assert lm_scoring.Places(own)(asked).tolist() == [at.get(int(x), -1) for x in asked]


def test_sums_are_sent_once_for_many_texts():
    """Texts' sums go out with the tokens of a task, not for each slice of texts."""
    sent = lambda x: type("Sent", (), {"value": x})
    shared = sent(lm_scoring.Shared(lm_scoring.Parts(16, np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0.0, np.array([0, 1], np.uint64), np.ones((2, 3), np.float32), np.ones((2, 3), np.float32)))
    frequent = sent(lm_scoring.Often(np.array([1, 0]), np.zeros(0, np.uint64), np.zeros(0, np.float32)))
    batch = pa.RecordBatch.from_pydict({"text": ["one two " * 2000] * 200, f"{lm_scoring.INNER}doc": list(range(200))})  # 3 MB
    out = pa.Table.from_batches(lm_scoring._asked(shared, frequent, "text")([batch]))
    sums = out.filter(pa.array(out.column("kind").to_numpy() == lm_scoring.SUMS))
    assert sums.num_rows <= 16
    own = [x for data in sums.column("data") for x in [lm_scoring.unpacked(data.as_py())]]
    assert sorted(np.concatenate([x["doc"] for x in own]).tolist()) == list(range(200)) and all((x["tokens"] == 4001).all() and (x["known"] == 1).all() for x in own)


def test_parts_go_to_different_tasks(spark):
    """A task that gets several parts holds them all at once."""
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (1, deal // 2, deal, 3 * deal + 1):
        names = lm_scoring.names_of(spark, n)
        assert len(set(names.tolist())) == n
        rows = spark.createDataFrame([(int(x),) for x in names], "part int").repartition(deal, "part").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in rows) <= -(-n // deal)


def test_scores_of_nothing(spark):
    docs = docs_of(spark, EDGE)
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0
    only = docs.where("doc_id = 5").withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)).cast("long"))
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in lm_scoring.score_texts(only).collect()] == [(0, 0, 0.0)]


# ---- 10 ---------------------------------------------------------------------------------------------------------------


def level(sizes, weights, total):
    """Targets by resharing until none is above its cap."""
    left, out = dict(sizes), {}
    rest = total
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: rest * weights[s] / w for s in left}
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
            del left[s]
    return out


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_sources(docs, keep=["doc_id", "source"]).toPandas()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, sum(sizes.values()))
    for s, own in got.groupby("source"):
        assert math.isclose(own["target"].iloc[0], want[s], rel_tol=1e-9) and own["source_size"].iloc[0] == sizes[s]
        assert abs(own["taken"].sum() - want[s]) <= own["size"].max()
        if sizes[s] <= want[s]:
            assert (own["copies"] >= 1).sum() >= (own["size"] > 0).sum() - 1
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() <= sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(5), keep=["doc_id", "source"]).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    rows = mixing.mixed_rows(docs).toPandas()
    assert rows.finish_time.is_monotonic_increasing and rows["size"].sum() == got["taken"].sum() and rows.groupby("doc_id").size().max() <= 3


def test_mix_cut_in_narrow_ranges(spark):
    """The same mix however few rows are sorted at the cut."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = lambda **x: mixing.mix_sources(docs, keep=["doc_id"], **x).orderBy("doc_id").select("doc_id", "taken").collect()
    assert own() == own(sorted_rows=1)


def test_mix_cases(spark):
    docs = docs_of(spark, EDGE)
    got = mixing.mix_sources(docs)
    assert got.count() == len(EDGE) and set(docs.columns) <= set(got.columns)
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert by[3, " \t\n\n "]["target"] == 0 and by[1, None]["size"] == 0 and by[1, None]["taken"] == 0 and by[4, "x"]["row"] == "r"
    assert mixing.mix_sources(docs.limit(0)).count() == 0 == mixing.mixed_rows(docs.limit(0)).count()


# ---- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    from gleaner.llm.common import read, written

    docs, step = read(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        step[name] = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        assert set(columns) <= set(docs.columns)
        if name != "source mix":
            assert docs.columns == columns
    texts = lambda name: {r["doc_id"]: r["text"] for r in step[name].collect()}
    first, clean, lines, near, decon = map(texts, ("toxicity", "line dedup", "near dedup", "decontamination", "source mix"))
    toxic = {r["doc_id"] for r in read(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(first.keys() - clean.keys()) <= 2 * len(toxic) and len(toxic - clean.keys()) >= 0.6 * len(toxic)
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in clean.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    keep = lambda i, x: len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)])
    assert lines == {i: "\n".join(x for x in t.split("\n") if keep(i, x)) for i, t in clean.items()}
    classes = brute_classes([(i, t) for i, t in lines.items()])
    assert set(near) == {i for i, t in lines.items() if not tokens(t) or classes[i] == i}
    items = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    leaked = {i for i, t in near.items() if any(edit_distance_in(tokens(lower(x)), tokens(lower(t))) <= len(tokens(x)) // 5 for x in items if any(w in t.lower() for w in tokens(lower(x))[:3]) and set(tokens(lower(x))[:12]) & set(tokens(lower(t))))} if len(near) < 400 else set()
    assert set(decon) == set(near) - leaked
    assert {r["doc_id"] for r in docs.collect()} <= set(decon) and docs.count() > 0


def test_nothing_else_uses_this_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not [p for p in own if re.search(r"\bllm\b", p.read_text())]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
