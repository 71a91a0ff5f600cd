"""Page merging by blocks against a plain walk over each document."""

import random
import re

import pytest

from quire.operators import quality as Q

TABLE, RULE = re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*\|?[\s:|-]+\|?\s*$")


def columns(line):
    return len(line.strip().strip("|").split("|"))


def facts(text):
    lines = text.split("\n") if text else []
    lead = 0
    while lead < len(lines) and TABLE.match(lines[lead]):
        lead += 1
    skip = 2 if lead >= 2 and RULE.match(lines[1]) else 0
    rows = [x for x in lines if TABLE.match(x)]
    filled = [x for x in lines if x.strip()]

    def item(x):
        num, mark = re.match(r"^(\d+)\.\s+", x), re.match(r"^([-*])\s+", x)
        return (int(num[1]) if num else None, mark[1] if mark else None)

    return {
        "n": len(lines), "lead": columns(lines[0]) if lead else None, "body": columns(lines[lead - 1]) if lead > skip else None,
        "rows": columns(rows[-1]) if rows else None, "first": item(filled[0]) if filled else (None, None), "last": item(filled[-1]) if filled else None,
    }


def walk(texts, keep_tail):
    begun, cols, last, out = False, None, (None, None), []
    for t in texts:
        s = facts(t)
        table = begun and s["lead"] is not None and cols == s["lead"]
        first = s["first"]
        both = last[0] is not None and first[0] is not None
        listed = begun and not table and (first[0] == last[0] + 1 if both else last[1] is not None and last[1] == first[1])
        out.append("first" if not begun else "table" if table else "list" if listed else "append")
        if table and not keep_tail:
            if s["body"] is not None:
                cols, last = s["body"], (None, None)
        elif listed and not keep_tail:
            last = first
        else:
            cols = s["rows"] if s["rows"] is not None else cols
            last = s["last"] if s["last"] is not None else last
        begun = begun or s["n"] > 0
    return out


def page(rnd):
    rows = ["| a | b |", "| a | b | c |"]
    kind = rnd.randrange(8)
    if kind == 0:
        return rnd.choice(["  ", " "])
    if kind == 1:
        r = rnd.choice(rows)
        return r + "\n" + "|".join(["---"] * (r.count("|") - 1)).join("||")
    if kind == 2:
        return "\n".join([rnd.choice(rows)] * rnd.randrange(1, 3) + ["text"] * rnd.randrange(2))
    if kind == 3:
        return "text\n" + rnd.choice(rows)
    if kind == 4:
        return f"{rnd.randrange(1, 5)}. one\n{rnd.randrange(1, 5)}. two"
    if kind == 5:
        return f"{rnd.choice('-*')} one\n{rnd.choice('-*')} two"
    if kind == 6:
        return f"text\n{rnd.randrange(1, 5)}. x"
    return f"{rnd.randrange(1, 5)}. x"


@pytest.mark.parametrize("keep_tail", [False, True])
def test_blocks_give_what_a_walk_gives(spark, monkeypatch, keep_tail):
    monkeypatch.setattr(Q, "PAGE_BLOCK", 3)
    rnd = random.Random(5)
    docs = {d: [page(rnd) for _ in range(rnd.choice([1, 2, 3, 7, 25, 60]))] for d in range(80)}
    rows = [(d, p, t) for d, texts in docs.items() for p, t in enumerate(texts)]
    joined = Q.merge_pages(spark.createDataFrame(rows, "doc_id long, page long, text string"), keep_tail)
    got = {(r["doc_id"], r["page"]): r["kind"] for r in joined.collect()}
    want = {(d, p): k for d, texts in docs.items() for p, k in enumerate(walk(texts, keep_tail))}
    wrong = [(k, want[k], got.get(k)) for k in want if want[k] != got.get(k)]
    assert len(got) == len(want) and not wrong, (wrong[:3], docs[wrong[0][0][0]][: wrong[0][0][1] + 1])
    assert {"table", "list", "append", "first"} == set(got.values())
    lists = {(r["doc_id"], r["kind"]): r["pages"] for r in Q.merged_lists(joined).collect()}
    assert all(lists[d, k] == [p for (e, p), x in sorted(got.items()) if e == d and x == k] for d, k in lists)
    assert sum(map(len, lists.values())) == sum(k in ("table", "list") for k in got.values())
