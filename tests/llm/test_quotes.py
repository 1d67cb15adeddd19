import re
from collections import defaultdict

from tradeweave.llm import quotes
from tradeweave.llm.common import table

from ..oracle import SMALL

MESSAGES = "conv_id long, turn int, role string, text string, thread int, position int, h long, source int"


def messages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], MESSAGES)


ROWS = [
    (1, 0, "user", "Hello there.\nHow does it work?\n\nSecond paragraph."),
    (1, 1, "assistant", "> How does it  WORK?\nLike this."),
    (1, 2, "user", "On Monday A wrote:\n> Like this.\n>> how does it work?\nThanks."),
    (1, 3, "user", "> Hello there.\n> How does it work?\nMe too."),
    (1, 4, "user", "No quotes."),
    (1, 5, "user", "> never said\nWell."),
    (1, 6, "user", None),
    (2, 0, "user", "> Like this.\nIn another conversation."),
    (None, 0, "user", "> x"),
    (3, None, "user", ""),
    (4, 0, "a", "same"),
    (4, 0, "a", "same"),
    (4, 1, "b", ">same"),
]


def test_links_threads_and_order(spark):
    got = quotes.conversations(messages_of(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: r.reply_to for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: None, 5: None, 6: None}
    assert {t: (r.thread, r.depth) for t, r in one.items()} == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    assert [one[t].position for t in range(7)] == list(range(7))
    assert one[2].own_text == "Thanks." and one[2].n_quoted == 2 and one[2].n_linked == 2 and one[1].own_text == "Like this."
    assert all(r.reply_to is None for r in got if r.conv_id in (2, 3, None))
    four = [r for r in got if r.conv_id == 4]
    assert sorted(r.position for r in four) == [0, 1, 2] and [r.reply_to for r in four if r.turn == 1] == [0]


def test_own_attributions_and_cut_quotes(spark):
    rows = [
        (1, 0, "a", "My grandmother once wrote:\nbe kind to all."),
        (1, 1, "b", "> My grandmother once wrote:\nWho?"),
        (2, 0, "a", "One paragraph that\nis long.\n\nTwo is\nlonger.\n\nThree."),
        (2, 1, "b", "On Monday A wrote:\n\n> One paragraph\n> that is long.\n>\n> Two\n> is longer.\nYes."),
        (2, 2, "a", "> On Monday A wrote:\n>> One paragraph that is long.\n> Yes.\nGood."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(messages_of(spark, rows)).collect()}
    assert got[1, 0].own_text == rows[0][3] and got[1, 1].own_text == "Who?"
    assert got[2, 1].own_text == "Yes." and got[2, 1].n_quoted == 5 and got[2, 2].n_quoted == 2
    assert {k: r.reply_to for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (2, 0): None, (2, 1): 0, (2, 2): 1}


def test_empty(spark):
    assert quotes.conversations(messages_of(spark, [])).collect() == []


def norm(s):
    return re.sub(r"\s+", " ", s.lower()).strip()


def brute(rows):
    """reply_to by (conversation, turn)."""
    by = defaultdict(list)
    for c, t, text in rows:
        if c is not None and t is not None:
            by[c].append((t, [(m[1].count(">"), line[m.end() :]) if not re.match(quotes.ATTRIBUTION, line.strip()) else (-1, line) for line in (text or "").replace("\r", "").split("\n") for m in [re.match(r"[ \t]*((?:>[ \t]?)*)", line)]]))
    out = {}
    for c, msgs in by.items():
        first = {}
        for t, lines in msgs:
            own = re.sub(r"^\s+|\s+$", "", "\n".join(b for n, b in lines if n == 0))
            for x in [*own.split("\n"), *re.split(r"\n\s*\n", own), own]:
                if norm(x):
                    first[norm(x)] = min(t, first.get(norm(x), t))
        for t, lines in msgs:
            hits = []
            runs = []
            for n, b in lines:
                if runs and runs[-1][0] == n:
                    runs[-1][1].append(b)
                else:
                    runs.append((n, [b]))
            for n, bs in runs:
                if n > 0:
                    hits += [(n, first[k]) for k in {norm(" ".join(bs)), *map(norm, bs)} if k in first and first[k] < t]
            if hits:
                outer = [s for n, s in hits if n == 1]
                out[c, t] = max(outer or [s for _, s in hits])
    return out


def test_small_table_by_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.text) for r in table(spark, SMALL, "conversations").collect()]
    got = quotes.op5_quotation_links(spark, SMALL).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None} == want
    at = defaultdict(list)
    for r in got:
        at[r.conv_id].append(r.position)
        assert not any(re.match(r"[ \t]*>", line) for line in (r.own_text or "").split("\n"))
    assert all(sorted(p) == list(range(len(p))) for p in at.values())
