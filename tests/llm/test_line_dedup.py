import random

from tests.llm.util import docs, words
from wardstat.llm.line_dedup import dedup_lines, repeated_runs


def brute(rows, min_lines=2, min_words=50):
    """Lines left of each row, by comparing every window with every earlier one."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = {}, {}
    numbered = {}
    for k in order:
        text = rows[k][1]
        numbered[k] = [] if text is None else [(n, x) for n, x in enumerate(text.split("\n"))]
    # windows of min_lines adjacent lines with words, and single lines
    for size in (1, min_lines):
        first = set()
        for k in order:
            ls = numbered[k]
            for a in range(len(ls) - size + 1):
                w = tuple(x for _, x in ls[a:a + size])
                if not all(x.strip() for x in w):
                    continue
                if (size, w) in first and (size == min_lines or w[0].count(" ") + 1 >= min_words):
                    seen.setdefault(k, set()).update(range(a, a + size))
                first.add((size, w))
    for k in order:
        text = rows[k][1]
        out[k] = None if text is None else "\n".join(
            x for n, x in numbered[k] if n not in seen.get(k, ()))
    return out


def check(spark, rows):
    want = brute(rows)
    got = dedup_lines(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(((r["row"]["doc_id"], r["row"]["text"]) for r in got), key=key) == sorted(
        ((rows[k][0], want[k]) for k in want), key=key)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [words(rng, rng.choice([2, 5, 60]), 10**6) for _ in range(40)] + ["", " "]
    rows = []
    for k in range(60):
        n = rng.randrange(0, 14)
        rows.append((100 - k, "\n".join(rng.choice(pool) if rng.random() < 0.5 else
                                        words(rng, 6, 10**6) for _ in range(n))))
    block = "\n".join(words(rng, 7, 10**6) for _ in range(37))      # a long run, many doublings
    for k in range(6):
        rows.append((200 + k, words(rng, 4) + "\n" + block + "\n" + words(rng, 4)))
    rows += [(300, block), (301, block), (302, block + "\n" + block), (303, "x\n" * 40),
             (304, "x\n" * 9 + "x"), (305, None), (306, "one"), (307, "one"), (308, words(rng, 60)),
             (None, "a\nb"), (309, "a\nb\nc"), (310, "b\nc")]
    check(spark, rows)


def brute_passages(rows, min_lines=2, min_words=50):
    """As ``brute``, by windows of lines with words; blank lines inside one go with it."""
    seen, out = set(), []
    for _, text in rows:
        lines, gone, new = text.split("\n"), set(), set()
        at = [k for k, x in enumerate(lines) if x.strip()]
        for size in (1, min_lines):
            for a in range(len(at) - size + 1):
                span = at[a:a + size]
                w = tuple(lines[k] for k in span)
                if w in seen and (size == min_lines or len(w[0].split()) >= min_words):
                    gone |= set(range(span[0], span[-1] + 1))
                seen.add(w)
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_passages_with_blank_lines(spark):
    rng = random.Random(12)
    passage = [words(rng, 20, 10**6) for _ in range(12)]
    own = lambda n: words(rng, n, 10**6)
    blanks = "a" + " " * 80
    rows = [(k, "\n\n".join([own(5), *passage, own(5)])) for k in range(4)]
    rows += [(4, "\n \n\n".join(passage[2:7])), (5, own(4) + "\n\n" + passage[3] + "\n\n" + own(4)),
             (6, own(3) + "\n\n" + blanks + "\n" + own(3)), (7, blanks + "\n\n" + own(3)),
             (8, "\n\n".join(passage))]
    pool = [words(rng, n, 10**6) for n in (3, 5, 60)] + ["", " ", "\t"]
    rows += [(10 + k, "\n".join(rng.choice(pool) if rng.random() < 0.7 else own(4)
                                for _ in range(rng.randrange(1, 12)))) for k in range(40)]
    got = {r["row"]["doc_id"]: r["row"]["text"] for r in dedup_lines(
        docs(spark, rows), blanks_break=False).collect()}
    assert len(got) == len(rows)
    for (k, _), want in zip(rows, brute_passages(rows)):
        assert got[k] == want, k
    assert got[1].count("\n") == 3 and got[4] == ""


def test_deepest_run_is_found(spark):
    ids = [bytes([k]) * 16 for k in (1, 2, 3, 4, 5, 6)]
    rows = [(0, 0, k, x, 5) for k, x in enumerate(ids)]
    rows += [(1, 1, k, x, 5) for k, x in enumerate(ids[:5])] + [(1, 1, 5, b"z" * 16, 5)]
    got = {(r["row"], r["i"]): r["h"] for r in repeated_runs(spark.createDataFrame(
        [(a, b, c, bytearray(d), e) for a, b, c, d, e in rows],
        "row long, doc_id long, i int, id binary, words int")).collect()}
    assert got == {(1, 0): 4, (1, 1): 4, (1, 2): 2, (1, 3): 2, (1, 4): 1}


def test_ties_and_empty_tables(spark):
    check(spark, [(1, "a\nb"), (1, "a\nb"), (1, "a\nb\nc")])
    check(spark, [(None, None), (None, "")])
    assert dedup_lines(docs(spark, [(1, "a")]).where("false")).count() == 0
