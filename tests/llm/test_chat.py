import random
import re

from quarrygraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARK = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")


def norm(t):
    return re.sub(r"\s+", " ", t).strip(" ").lower()


def keys(body):
    return {p for p in [norm(body), *map(norm, body.split("\n"))] if len(p) >= 12}


def brute(rows):
    """Own text, passages, parent and thread of each message by comparing every pair."""
    parsed = []
    for c, t, role, text in rows:
        lines = [(m[1].count(">") if (m := MARK.match(x)) else 0, MARK.sub("", x)) for x in re.split(r"\r?\n", text or "")]
        lines = [x for k, x in enumerate(lines) if not (k + 1 < len(lines) and lines[k + 1][0] > x[0] and re.match(r"(?i)^\s*on\b.*\bwrote\s*:\s*$", x[1]))]
        own = "\n".join(b for level, b in lines if level == 0).strip()
        passages, last = [], 0
        for level, body in lines:
            if level and level == last:
                passages[-1] = (level, passages[-1][1] + "\n" + body)
            elif level:
                passages.append((level, body))
            last = level
        parsed.append((c, t, own, passages))
    out, group = [], {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for c, t, own, passages in parsed:
        best = {}
        if c is not None and t is not None:
            votes = {}
            for level, body in passages:
                for k in keys(body):
                    owners = sorted((oc, ot) for oc, ot, oo, _ in parsed if oc is not None and ot is not None and k in keys(oo))
                    same = [o for o in owners if o[0] == c][:1]
                    o = same[0] if same and same[0][1] < t else owners[0] if owners and owners[0][0] < c else None
                    if o:
                        votes.setdefault(level, {}).setdefault(o, 0)
                        votes[level][o] += len(k)
            best = {level: max(v, key=lambda o: (v[o], o[0] == c, -o[0], -o[1])) for level, v in votes.items()}
            for o in best.values():
                a, b = find(o[0]), find(c)
                group[max(a, b)] = min(a, b)
        before = [ot for oc, ot, _, _ in parsed if c is not None and t is not None and oc == c and ot is not None and ot < t]
        parent = best[min(best)] if best else (c, max(before)) if before else (None, None)
        out.append([c, t, own, len(passages), len(best), *parent])
    return sorted(([find(x[0]) if x[0] is not None and x[1] is not None else None, *x] for x in out), key=str)


def run(spark, rows):
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    return sorted(([r.thread_id, r.conv_id, r.turn, r.content, r.n_quotes, r.n_linked, r.parent_conv, r.parent_turn] for r in got.collect()), key=str)


def test_nested_quotes_and_threads(spark):
    rows = [
        (1, 0, "Human", "How do I sort a list in place?\nThanks in advance, friends."),
        (1, 1, "assistant", "> How do I sort a list in place?\nCall its sort method."),
        (1, 2, "user", "On Monday Ann wrote:\n> > How do I  SORT a list in place?\n> Call its sort method.\n\nAnd backwards?"),
        (5, 0, "user", ">Call its sort method.\r\nDoes that copy the list?"),
        (5, 3, "bot", ">> Call its sort method.\n> Does that copy the list?\nNo."),
        (9, 0, "user", "> never said by anyone here\nquote of nothing"),
        (9, 2000, "user", "much later"), (9, 5000, None, None), (None, 1, "user", "> Call its sort method.\nno conversation"), (9, None, "user", "no turn"),
        (9, 2000, "user", "much later"),
    ]
    assert run(spark, rows) == brute(rows)
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2].content == "And backwards?" and (got[1, 2].parent_conv, got[1, 2].parent_turn) == (1, 1)
    assert got[5, 0].thread_id == 1 and got[5, 3].role == "assistant"
    assert got[1, 0].formatted.startswith("<|user|>\nHow do I")


def test_random_threads_match_brute_force(spark):
    rng = random.Random(4)
    said, rows = [], []
    for c in range(25):
        for t in range(rng.randrange(1, 6)):
            own = [f"line {rng.randrange(60)} of what was said" for _ in range(rng.randrange(1, 4))]
            quote = []
            for level in range(rng.randrange(3), 0, -1):
                if said:
                    quote += [">" * level + " " + x for x in rng.choice(said)[: rng.randrange(1, 4)]]
            rows.append((c, t, "user", "\n".join(quote + own)))
            said.append(own)
    assert run(spark, rows) == brute(rows)
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = con.sql(chat.ORACLE)
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_test_table_keeps_every_message(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = chat.format_chats(table)
    assert got.count() == table.count()
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == brute(rows)
    assert chat.format_chats(table.limit(0)).count() == 0


def test_very_many_passages_in_one_message(spark):
    import time

    lines = [f"{'>' * (k % 3)} line {k} of the long message" for k in range(20_000)]
    said = spark.createDataFrame([(1, 0, "user", "\n".join(lines))], "conv_id long, turn long, role string, text string")
    start = time.time()
    found = chat.parse_messages(said).first().passages
    assert time.time() - start < 20
    assert len(found) == 13_333 and found[1].body.strip() == "line 2 of the long message" and found[1].level == 2
