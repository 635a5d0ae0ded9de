"""Filter audit against a walk of every document through every order."""

import itertools
import random
import re

from sparkrank.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def walked(docs, labels):
    """The rows of the audit by definition."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts, out = {}, {}
    texts = [(d, text or "") for d, text, _ in docs]
    for d, text, source in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and any(o is not None and o < d and x == text for o, x in texts),
        }
        parts.setdefault(source or "", []).append((d, fails))
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if r[1][f]]
                earlier = [r for r in gone if r[1][f]]
                left, gone = [r for r in left if not r[1][f]], gone + hit
                only = [r for r in rows if r[1][f] and sum(r[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(hit), len(earlier), len(only), sum(r[0] in good for r in hit), sum(r[0] in toxic for r in hit)]
    for (part, order, step), row in out.items():
        row.append(sum(x[1] for (p, o, s), x in out.items() if p == part and o[s - 1] == order[step - 1]) if step else 0)
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS mask", "3 AS n", "'x' AS digest", "4 AS good", "5 AS words", "6 AS cells")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS mask")
    rows = filter_audit.interaction_audit(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_a_walk_through_every_order(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.choice([3, 199, 200, 300]))) for _ in range(6)]
    texts += [t + m for t in texts for m in (" #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\x0b|")] + [None, "", " \n", "one " * 500]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["a", "b", "", None])) for _ in range(150)]
    docs += docs[:10]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    assert audited(spark, docs, labels) == walked(docs, labels)


def test_copies_of_other_parts_and_bounds(spark):
    half = " ".join(f"w{i}" for i in range(100)) + " " + "w1 " * 100
    docs = [(3, "x", "late"), (1, "x", "early"), (3, "x", "late"), (None, "x", "late"), (10, half, "n"), (11, "A" + "b" * 49, "n"), (12, "A" + "b" * 48, "n")]
    found = audited(spark, docs, [])
    assert found == walked(docs, [])
    assert found["late", "EABCD", 1][:2] == (1, 2) and found["early", "EABCD", 1][:2] == (1, 0)
    assert found["n", "BCADE", 1][1] == 0 and found["n", "CABDE", 1][1] == 1


def test_every_order_and_step_is_there(spark):
    found = audited(spark, [(1, "a", "p")], [(1, 1, 1), (1, 0, 0)])
    assert len(found) == 600 and {o for _, o, _ in found} == {"".join(p) for p in itertools.permutations("ABCDE")}
    assert found["p", "ABCDE", 1] == (0, 1, 0, 1, 1, 1, 120) and found["p", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)
