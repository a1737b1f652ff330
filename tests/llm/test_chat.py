import random

from pointloom.llm.chat import collapse, render

MARK = "<|{}|>\n{}<|end|>\n"


def plain(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or "", role, text))
    lists = {c: [x[-2:] for x in sorted(v, key=lambda x: x[:6])] for c, v in convs.items()}
    groups = {}
    for c, l in lists.items():
        groups.setdefault(tuple(l), []).append(c)
    out = []
    for l, ids in groups.items():
        if not any(len(o) > len(l) and o[: len(l)] == l for o in groups):
            known = [i for i in ids if i is not None]
            out.append((min(known) if known else None, len(l), len(ids), "".join(MARK.format(r if r is not None else "unknown", t or "") for r, t in l)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(4)
    rows = []
    for c in range(150):
        turns = [("user", "hi"), *((r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None])) for _ in range(r.randrange(4)))]
        rows += [(c if c != 77 else None, n, *t) for n, t in enumerate(turns)]
    rows += [(500, None, "user", "x"), (500, 1, "user", "y"), (501, 1, "user", "y"), (501, 1, "system", "y"), (502, 0, "user", "z" * 100_000)] + rows[:4]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, i int, n_copies int").repartition(5)
    got = sorted((tuple(x) for x in render(collapse(df)).collect()), key=repr)
    assert got == plain(rows)
    assert render(collapse(df.limit(0))).count() == 0
