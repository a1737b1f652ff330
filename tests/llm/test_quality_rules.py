import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pointloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, each by its definition."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated), len(lines)


def measures(c):
    n, chars, symbols, dup, repeat, lines = c
    return [chars * 1000 // n if n else None, symbols * 10000 // chars if chars else None, dup * 10000 // lines if lines else None, repeat * 10000 // n if n else None]


def floor64(v):
    return v if v < 64 else v >> (v.bit_length() - 7) << (v.bit_length() - 7)


def plain(rows):
    """Verdicts of rows (lang, source, text), with quartiles read from sorted values."""
    counted = [plain_counts(t) for _, _, t in rows]
    base = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counted]
    groups = defaultdict(lambda: [[] for _ in range(4)])
    for (lang, source, _), c, bad in zip(rows, counted, base):
        for k, v in enumerate(measures(c)) if not bad else ():
            for key in ((lang, source), (lang,), ()):
                if v is not None:
                    groups[key][k].append(floor64(v))
    out = []
    for (lang, source, _), c, bad in zip(rows, counted, base):
        kept = not bad
        for k, (v, (_, low, least)) in enumerate(zip(measures(c), q.MEASURES.values())):
            if v is None or not groups[lang, source][k]:
                continue
            values = next(x for x in (groups[lang, source][k], groups[lang,][k], groups[()][k]) if len(x) >= q.LEAST_DOCS or x is groups[()][k])
            ranked = sorted(values)
            q1, q3 = (ranked[-(-p * len(ranked) // 4) - 1] for p in (1, 3))
            width = q.REACH * max(q3 - q1, least)
            kept = kept and v <= q3 + width and not (low and v < q1 - width)
        out.append((*c[:5], bad, kept))
    return out


def text(r, words, size):
    return " ".join(r.choice(words) + ("\n" if r.random() < 0.1 else "") for _ in range(size))


def test_equals_plain_version(spark):
    r = random.Random(11)
    vocabulary = {k: ["".join(r.choice("abcdefgé🙂") for _ in range(r.randrange(1, k))) for _ in range(200)] for k in (5, 9, 14)}
    rows = []
    for n in range(700):
        lang, source = r.choice(["en", "de", None]), r.choice(["hot", "hot", "hot", "cold", None, f"s{n % 40}"])
        rows.append((lang, source, text(r, vocabulary[5 if lang == "en" else 9], r.randrange(20, 200))))
    rows += [("en", "hot", text(r, vocabulary[14], 90)) for _ in range(20)] + [("en", "hot", text(r, ["a", "#", "$$"], 90)) for _ in range(5)]
    rows += [("en", "hot", "one two three four five " * n) for n in (1, 2, 30)] + [("en", "hot", f"same line here\n{n} other words\nsame line here \n" * 9 + text(r, vocabulary[9], 80)) for n in range(5)]
    rows += [("en", "x", t) for t in (None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a a a", "\x85 \xa0b c d\x0b\x0cc", "a b c a b c", "ab c\x1fd " * 40)]
    rows += [("xx", "alone", text(r, vocabulary[9], 70)), ("en", "hot", " ".join(str(n % 7001) for n in range(70_000)))] + rows[:3] * 2
    data = [(n if n % 9 else None, t, lang, source, "s", 1, 2) for n, (lang, source, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, words string, salt int, kept int").repartition(6)
    found = q.assess(df).select("doc_id", *q.COUNTS, "base_failed", "kept").collect()
    want = [(d[0], *p) for d, p in zip(data, plain(rows))]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert 10 < sum(not x[-1] and not x[-2] for x in want) < 100
    kept = q.keep(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((d for d, w in zip(data, want) if w[-1]), key=repr)
    assert q.assess(df.limit(0)).count() == 0


def test_sketches_merge_to_the_same(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), None if n % 50 == 0 else int(10 ** r.uniform(0, 9)), n % 3, n, 0) for n in range(3000)]
    df = spark.createDataFrame(rows, "source string, word_length long, symbol_share long, line_share long, repeat_share long")
    parts = [q.sketch(df.filter(F.col("line_share") % 4 == k), ["source"]) for k in range(4)]
    union = parts[3].unionByName(parts[1]).unionByName(parts[0]).unionByName(parts[2])
    whole = q.sketch(df, ["source"])
    assert sorted(q.merged(union, ["source"]).collect()) == sorted(whole.collect())
    for row in q.quartiles(whole, ["source"]).filter("measure = 'word_length'").collect():
        values = sorted(v for s, v, *_ in rows if s == row["source"] and v is not None)
        for p, got in ((1, row["q1"]), (3, row["q3"])):
            true = values[-(-p * len(values) // 4) - 1]
            assert got <= true <= got + got // 64


def test_buckets_hold_their_numbers(spark):
    numbers = [*range(300), *(2**k + d for k in range(9, 62) for d in (-1, 0, 1))]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", q.bucket(F.col("n")).alias("b")).withColumn("low", q.lower(F.col("b"))).collect()
    assert all(x["low"] == floor64(x["n"]) for x in got)
    order = sorted(got, key=lambda x: x["n"])
    assert all(a["b"] <= b["b"] for a, b in zip(order, order[1:]))
