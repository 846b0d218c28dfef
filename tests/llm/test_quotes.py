import random

from tessera.llm.quotes import LEAST, SHORT, link_quotations, lines_by_level, parse, thread_roots, unit_hash

SCHEMA = "conv_id long, turn long, role string, text string, first string, level int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)


def test_levels_and_attributions():
    text = "Hi\nOn Monday Ann wrote:\n> quoted line\n>> deeper\n> > also deeper\nmine\n    > code stays"
    assert lines_by_level(text) == [(0, "Hi"), (1, "quoted line"), (2, "deeper"), (2, "also deeper"), (0, "mine"), (0, "    > code stays")]
    own, units, quoted = parse("> a long enough passage\n> on two whole lines\n\nmy own answer here")
    assert own == "my own answer here" and [q[:4] for q in quoted] == [(0, 1, 0, 0), (0, 1, 1, 0), (0, 1, 1, 1)]
    assert unit_hash("A long  ENOUGH\npassage on two lines") == unit_hash("a long enough passage\non two lines")
    assert unit_hash("ok, thanks") is None and LEAST == 12
    assert parse("") == ("", [], [])


def test_attributions_by_structure():
    for line in ("Ann wrote:", "On 3 May 2024 at 10:12, Ann Lee wrote:", "ann@example.org:", "Le 3/5/24, Anne a écrit :".replace(" :", ":"), "2024-05-03 10:12 Анна пишет:"):
        assert lines_by_level(f"{line}\n> quoted line") == [(1, "quoted line")], line
    for line in ("I disagree with this:", "See below", "Two things:"):
        assert lines_by_level(f"{line}\n> quoted line") == [(0, line), (1, "quoted line")], line


def test_least_is_a_parameter(spark):
    rows = [(1, 1, "user", "Sounds good to me"), (2, 1, "user", "> Sounds good to me\nand me")]
    linked = lambda **more: {r.conv_id: r.n_linked for r in link_quotations(frame(spark, rows), **more).collect()}
    assert linked() == {1: 0, 2: 1} and linked(least=20) == {1: 0, 2: 0}


def test_very_long_text(spark):
    lines = [f"line number {i} of a very long message" for i in range(60_000)]
    rows = [(1, 1, "user", "\n".join(lines)), (1, 2, "assistant", "\n".join("> " + x for x in lines) + "\n\nread it"), (1, 3, "user", "x" * 2_000_000)]
    got = {r.turn: r for r in link_quotations(frame(spark, rows)).collect()}
    assert (got[2].text, got[2].n_quotes, got[2].n_linked, got[2].parent_turn) == ("read it", 1, 1, 1) and len(got[3].text) == 2_000_000


def brute(rows):
    """Every quoted passage against every message, one pair at a time."""
    said = [(c, t, r, parse(x or "")) for c, t, r, x in rows]
    out = []

    def original(c, t, h):
        have = [(c2, t2) for c2, t2, _, p in said if c2 is not None and t2 is not None and h in p[1]]
        inside = min([t2 for c2, t2 in have if c2 == c], default=None)
        if inside is not None and inside < t:
            return (c, inside)
        return min(((c2, t2) for c2, t2 in have if c2 != c and len(h) != SHORT), default=None)

    parents = {}
    for c, t, r, (own, _, quoted) in said:
        links = {}
        for k, level, kind, line, h in sorted(quoted):
            to = original(c, t, h) if c is not None and t is not None else None
            links.setdefault((k, level), to)
            if links[k, level] is None:
                links[k, level] = to
        found = [(to[0] == c, -level, to[1], to) for (k, level), to in links.items() if to]
        parent = max(found, default=(0, 0, 0, (None, None)))[3]
        placed = c is not None and t is not None
        if parent[0] == c and parent[0] is not None:
            parents[c, t] = max(parent[1], parents.get((c, t), -1))
        out.append([c, t, r, own, max([q[1] for q in quoted], default=0) if placed else 0, len({q[0] for q in quoted}), len(found), *parent])
    for row in out:
        at, depth = row[1], 0
        while (row[0], at) in parents:
            at, depth = parents[row[0], at], depth + 1
        row += [at, depth]
    return sorted(map(tuple, out), key=str)


def chat(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice([0, 0, 0, 1, 2, 3])
        lines = [f"{rng.choice(['alpha', 'beta', 'gamma'])} sentence number {rng.randint(0, 400)}" for _ in range(rng.randint(1, 4))]
        if rows and rng.random() < 0.7:
            _, _, _, old = rng.choice(rows[-12:])
            old = (old or "").split("\n")
            a = rng.randint(0, len(old) - 1)
            quote = ["> " + x for x in old[a : a + rng.randint(1, 3)]]
            lines = [*(["Bob wrote:"] if rng.random() < 0.5 else []), *quote, *([""] if rng.random() < 0.3 else []), *lines]
        rows.append((c, i, rng.choice(["user", "assistant"]), "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rows = chat(1) + chat(2, 60)[:1]
    rows += [(0, 500, "user", None), (None, 3, "user", rows[0][3]), (5, None, "user", "> " + rows[1][3].split("\n")[-1]), (6, 1, "user", ""), rows[4], rows[50]]
    df = link_quotations(frame(spark, rows))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == brute(rows)
    assert sum(1 for r in got if r[6]) > 30 and max(r[-1] for r in got) > 2


def test_replies_follow_what_they_answer(spark):
    rows = [(0, 0, "a", "the first question asked here"), (0, 1, "b", "an unrelated remark by someone"), (0, 2, "a", "> the first question asked here\nmy answer to the question"), (0, 3, "b", ">> the first question asked here\n> my answer to the question\nthanks a lot for the answer")]
    got = [tuple(r) for r in link_quotations(frame(spark, rows)).coalesce(1).collect()]
    assert [r[1] for r in got] == [0, 2, 3, 1]
    assert got[2][3:] == ("thanks a lot for the answer", 2, 2, 2, 0, 2, 0, 2)
    assert link_quotations(frame(spark, [])).count() == 0


def test_long_threads(spark):
    up = spark.createDataFrame([(1, i, i - 1) for i in range(1, 200)] + [(2, 9, 4)], "conv long, turn long, up long")
    got = {(r.conv, r.turn): (r.root, r.depth) for r in thread_roots(up).collect()}
    assert got == {(1, i): (0, i) for i in range(1, 200)} | {(2, 9): (4, 1)}


def test_short_quotations_link_within_their_conversation(spark):
    rows = [(0, 0, "a", "Sounds good"), (0, 1, "b", "はい"), (0, 2, "a", "> Sounds good\nok"), (0, 3, "b", "> はい\nthen\n> :-)"), (1, 0, "a", "> sounds  GOOD\nwell")]
    got = {(r.conv_id, r.turn): tuple(r)[3:] for r in link_quotations(frame(spark, rows)).collect()}
    assert got[0, 2] == ("ok", 1, 1, 1, 0, 0, 0, 1)
    assert got[0, 3] == ("then", 1, 2, 1, 0, 1, 1, 1)
    assert got[1, 0] == ("well", 1, 1, 0, None, None, 0, 0)


def test_originals_beyond_the_own_conversation(spark):
    line = "a line that is said in many places"
    rows = [(0, 1, "a", f"> {line}\nfirst answer"), (0, 1, "b", line), (3, 5, "a", line), (2, 8, "b", line), (2, 9, "a", line), (2, 3, "b", f"> {line}\nanother answer"), (7, 0, "a", f"> {line}\nthird answer")]
    said = {(c, t) for c, t, _, x in rows if unit_hash(line) in parse(x)[1]}
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in link_quotations(frame(spark, rows)).where("n_quotes > 0").collect()}
    assert got == {(c, t): min(o for o in said if o[0] != c) for c, t in ((0, 1), (2, 3), (7, 0))} == {(0, 1): (2, 8), (2, 3): (0, 1), (7, 0): (0, 1)}
