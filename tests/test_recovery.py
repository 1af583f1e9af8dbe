"""Form recovery, page rounds, draft blocks, stores and sources against written results and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import forms, rounds
from folioflow.plans import recovery
from folioflow.plans.registry import Tables

from .conftest import SMALL

KEY = ["doc_id", "page", "region_id"]


def form(spark, *texts, schema="doc_id bigint, page bigint, region_id string, type string, text string"):
    return spark.createDataFrame([(1, 1, f"r{i}", "table", t) for i, t in enumerate(texts)], schema)


def states(df, marks=True):
    return [(r.label, r.occurrence, r.state) for r in forms.option_states(df, KEY, "text", marks).orderBy("label", "occurrence").collect()]


def test_option_states(spark):
    apart = form(spark, "<table><TR><td> ☒ </td><td>Office</td></TR><tr><td>x</td><td>note</td><td>office:</td></tr><tr><td>☐</td><td>[x] Office</td></tr></table>")
    assert states(apart) == [("office", 0, "checked"), ("office", 1, None), ("office", 2, "checked")]
    assert states(apart, marks=False) == [("office", 0, None), ("office", 1, None), ("office", 2, "checked")]
    either = form(spark, "<tr><td>X</td><td>Participating</td><td></td><td>Nonparticipating</td></tr>")
    assert states(either) == [("nonparticipating", 0, "unchecked"), ("participating", 0, "checked")]
    assert states(form(spark, "no table", "", None)) == []
    assert states(form(spark, "<td>[ ] Home</td><td>[?] Hospice</td><td>☑Office</td>")) == [("home", 0, "unchecked"), ("hospice", 0, None), ("office", 0, "checked")]


def test_cells_are_replaced_in_place(spark):
    html = "a<TABLE><td class='x'>1</td>mid<th>2\n</th><td></td></TABLE>z"
    df = spark.createDataFrame([(html,)], "text string")
    got = df.select(forms.with_cells(F.col("text"), F.create_map(F.lit(0), F.lit("one"), F.lit(2), F.lit("$1\\")))).first()[0]
    assert got == "a<TABLE><td class='x'>one</td>mid<th>2\n</th><td>$1\\</td></TABLE>z"
    for plain in ("no cells", "", None):
        assert spark.createDataFrame([(plain,)], "text string").select(forms.with_cells(F.col("text"), F.create_map(F.lit(0), F.lit("x")))).first()[0] == plain


def test_recovery_statuses(spark):
    row = lambda mark, label: f"<tr><td>{mark}</td><td>{label}</td></tr>"
    table = lambda name, *rows: f"<table><tr><th>{name}</th></tr>{''.join(rows)}</table>"
    open_ = lambda name: table(name, row("", "Office"), row("", "[x] Home"))
    regions = spark.createDataFrame(
        [(1, 1, "a", "table", open_("A")), (1, 1, "t", "text", open_("A")), (1, 2, "b", "form", open_("B")), (1, 3, "c", "table", open_("C")), (1, 3, "d", "table", open_("c")), (1, 4, "e", "table", open_("E")), (2, 1, "f", "table", table("F", row("☐", "Office"), row("", "[x] Home"))), (2, 2, "g", "table", open_("G"))],
        "doc_id bigint, page bigint, region_id string, type string, text string",
    )
    read = lambda doc, page, *texts: [(doc, page, r, t) for r, t in enumerate(texts, 1) if t is not None]
    yes, no = row("☒", "Office") + row("☒", "Home"), row("☐", "Office") + row("☒", "Home")
    readings = spark.createDataFrame(read(1, 1, table("a", yes), table("A", yes)) + read(1, 2, table("B", yes), table("B", no)) + read(1, 3, open_("c"), open_("c")) + read(2, 2, table("G", yes), None), "doc_id bigint, page bigint, reading int, content string")
    got = {r.region_id: (r.status, r.n_resolved) for r in forms.recover_forms(regions, readings, ["doc_id"], 3).collect()}
    assert got == {"a": ("resolved", 1), "b": ("disagreed", 0), "c": ("ambiguous", 0), "d": ("ambiguous", 0), "e": ("deferred", 0), "f": ("complete", 0), "g": ("unavailable", 0)}
    fine = spark.createDataFrame([(1, 2, "b", table("B", row("", "[ ] Office"), row("", "[x] Home")))], "doc_id bigint, page bigint, region_id string, recovered string")
    b = forms.recover_forms(regions, readings, ["doc_id"], 3, fine).where("region_id = 'b'").first()
    assert (b.merge_status, b.n_merged) == ("resolved", 2) and "[ ] Office" in b.text and "[x] Home" in b.text


def test_merge_keeps_what_it_does_not_know(spark):
    f = lambda own, other: spark.createDataFrame([(1, own, other)], "k bigint, text string, recovered string")
    merge = lambda own, other: tuple(forms.merge_forms(f(own, other), ["k"]).select("text", "merge_status", "n_merged").first())
    assert merge("<td>[x] Office</td>", "<td>[ ] Office</td>") == ("<td>[?] Office</td>", "conflict", 0)
    assert merge("<td>Office</td><td>Home</td>", "<td>[x] Office</td>") == ("<td>[x] Office</td><td>[?] Home</td>", "partial", 1)
    assert merge("<td>Office</td>", "") == ("<td>[?] Office</td>", "ambiguous", 0)
    assert merge("<td>Name:</td><td> </td>", "<td>NAME:</td><td>A &amp; <b>B</b></td>") == ("<td>Name:</td><td>A &amp; B</td>", "resolved", 1)
    assert merge("<td>Name:</td><td></td>", "<td>Other:</td><td>A</td>") == ("<td>Name:</td><td></td>", "unchanged", 0)
    assert merge("plain", "<td>x</td>") == ("plain", "unchanged", 0)


BLOCKS = "page bigint, id string, type string, text string, status string, confidence double, has_box boolean, reading_order bigint"
TURNS, ANSWERS = "page bigint, round int", "page bigint, round int, id string, version int, action string, confidence double, text string"


def drawn(seed: int):
    r = random.Random(seed)
    blocks = [(p, f"b{i}", r.choice(["paragraph", "figure", "table"]), r.choice(["plain", "Id2 ABC", "##", None]), r.choice(["pending", "needs_review", "rejected"]), r.choice([None, 0.2, 0.9]), r.random() < 0.8, r.randrange(4)) for p in range(6) for i in range(8)]
    turns = [(p, n) for p in range(6) for n in (1, 2, 3) if r.random() < 0.85]
    answers = [(p, n, f"b{r.randrange(9)}", r.randrange(3), r.choice(["accept", "correct", "reject", "inspect", "unclear"]), r.choice([0.5, 0.9, None]), r.choice(["new", None, " ", "plain"])) for p, n in turns for _ in range(20)]
    return blocks, turns, answers


def frames(spark, drawn_):
    return rounds.start(spark.createDataFrame(drawn_[0], BLOCKS)), spark.createDataFrame(drawn_[1], TURNS), spark.createDataFrame(drawn_[2], ANSWERS)


def by_hand(blocks, turns, answers, most):
    names = BLOCKS.replace("bigint", "").replace("string", "").replace("double", "").replace("boolean", "").replace(" ", "").split(",")
    out = []
    for page in sorted({b[0] for b in blocks}):
        own = [{**dict(zip(names, b)), "round": 0, "version": 0, "reason": None, "recovered": False} for b in blocks if b[0] == page]
        for n in (1, 2, 3):
            if (page, n) not in turns:
                break
            own = rounds.advance(own, [dict(zip(("id", "version", "action", "confidence", "text"), a[2:])) for a in answers if a[:2] == (page, n)], n, most)
        out += own
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_in_columns_equal_rounds_by_hand(spark, seed):
    made = drawn(seed)
    got = rounds.run(*frames(spark, made), ["page"], most=2).collect()
    key = lambda r: (r["page"], r["id"])
    pick = lambda r: {f: r[f] for f in ("page", *rounds.FIELDS)}
    assert [pick(r) for r in sorted(got, key=key)] == [pick(r) for r in sorted(by_hand(*made, 2), key=key)]
    assert len({r.status for r in got}) >= 3


def test_a_replayed_round_changes_nothing(spark):
    blocks, turns, answers = frames(spark, drawn(4))
    once = rounds.run(blocks, turns, answers, ["page"])
    again = rounds.step(rounds.step(once, turns, answers, ["page"], 1), turns, answers, ["page"], 2)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    first = rounds.step(blocks, turns, answers, ["page"], 1)
    assert {r.outcome for r in rounds.judged(first, answers, ["page"], 1).join(turns.where("round = 1").select("page"), "page").collect()} <= {"replayed", "unexpected"}
    seen = {r.outcome for r in rounds.judged(blocks, answers, ["page"], 1).collect()}
    assert {"applied", "stale", "unexpected"} <= seen


def test_stream_of_rounds_equals_the_batch(spark, tmp_path):
    made = drawn(5)
    names = [f for f in BLOCKS.replace(",", "").split() if f not in ("bigint", "string", "double", "boolean")]
    events = [(p, 0, json.dumps([dict(zip(names[1:], b[1:])) for b in made[0] if b[0] == p])) for p in range(6)]
    events += [(p, n, json.dumps([dict(zip(("id", "version", "action", "confidence", "text"), a[2:])) for a in made[2] if a[:2] == (p, n)])) for p, n in made[1]]
    events += random.Random(6).sample(events, 8)  # delivered again
    random.Random(7).shuffle(events)
    source = str(tmp_path / "events")
    for i in range(0, len(events), 7):
        spark.createDataFrame(events[i : i + 7], "page bigint, round int, payload string").coalesce(1).write.mode("append").parquet(source)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = spark.readStream.schema("page bigint, round int, payload string").option("maxFilesPerTrigger", 2).parquet(source)
        q = rounds.stream(read, ["page"], most=2).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert rows.groupBy("page", "id", "round").count().where("count > 1").isEmpty()  # nothing is given twice
    last = rows.groupBy("page", "id").agg(F.max_by(F.struct(*rows.columns), "round").alias("x")).select("x.*")
    batch = rounds.run(*frames(spark, made), ["page"], most=2).where("round > 0").select(*last.columns)
    assert last.count() == batch.count() > 0 and last.exceptAll(batch).isEmpty() and batch.exceptAll(last).isEmpty()


def test_rounds_meet_every_outcome(spark):
    found = set()
    for seed in (1, 2, 3):
        made = drawn(seed)
        for n in (1, 2, 3):
            upto = [t for t in made[1] if t[1] <= n]
            found |= {(r["status"], r["reason"]) for r in by_hand(made[0], upto, made[2], 1)}
    assert {"verified", "needs_review", "rejected", "inspect", "pending"} <= {s for s, _ in found}
    assert {r for _, r in found} >= {None, rounds.UNANSWERED, rounds.SEVERAL, rounds.UNSURE, rounds.INCONCLUSIVE, rounds.NO_BOX, rounds.REFUSED, rounds.UNCHANGED}


def test_crops_beyond_the_limit_ask_for_review(spark):
    blocks = [(1, f"b{i}", "paragraph", "plain", "pending", 0.1 * i, True, i) for i in range(1, 5)] + [(1, "f", "figure", None, "pending", 0.9, True, 9)]
    turns = [(1, 1), (1, 2)]
    answers = [(1, 1, f"b{i}", 0, "inspect", None, None) for i in range(1, 5)] + [(1, 2, "b1", 1, "accept", None, None), (1, 2, "f", 0, "correct", 0.9, "seen"), (1, 2, "b2", 1, "accept", None, None)]
    got = {r.id: (r.status, r.reason, r.version, r.recovered) for r in rounds.run(*frames(spark, (blocks, turns, answers)), ["page"], most=1).collect()}
    over = ("needs_review", rounds.LIMIT, 2, False)
    assert got == {"b1": ("verified", None, 2, False), "b2": over, "b3": over, "b4": over, "f": ("verified", None, 1, True)}
    assert got == {r["id"]: (r["status"], r["reason"], r["version"], r["recovered"]) for r in by_hand(blocks, turns, answers, 1)}


def test_page_rounds_change_states(spark):
    rows = recovery.page_rounds(Tables(spark, SMALL)).collect()
    assert {"verified", "needs_review", "pending"} <= {r.status for r in rows} and len({r.reason for r in rows}) >= 5 and any(r.recovered for r in rows)


def test_forms_are_read_and_merged_in_their_rows(spark):
    """readings of long forms meet in linear passes of their rows, without any shuffle of cells."""
    n = 2000
    table = lambda sign: "<table><tr><th>A</th></tr>" + "".join(f"<tr><td>{sign(i)}</td><td>Office</td><td>Why:</td><td> </td></tr>" for i in range(n)) + "</table>"
    own, other = table(lambda i: ""), table(lambda i: "x" if i % 2 else "")
    frame = spark.createDataFrame([(1, own, own.replace("<td>Office", "<td>[x] OFFICE &amp;").replace(" &amp;", "").replace("> <", ">yes<"))], "k int, text string, recovered string")
    merged = forms.merge_forms(frame, ["k"])
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    r = merged.first()
    assert (r.merge_status, r.n_merged) == ("resolved", 2 * n) and r.text.count("[x] Office") == n and r.text.count(">yes<") == n
    read = form(spark, other).select(*KEY, F.explode(forms.states_of(F.col("text"))).alias("s")).select("s.occurrence", "s.state").collect()
    assert sorted(tuple(x) for x in read) == [(i, "checked" if i % 2 else None) for i in range(n)]


@pytest.mark.parametrize("said", ["x Office", "[?] home  health :", "x", "X", "Office::", "officer", "s\u212ailled nursing facility", "<b>Office</b>&nbsp;:", "a &amp; b", " Hospice\u00a0", "\u2611Home\n", "", " ", "office: :"])
def test_short_ways_read_as_the_long_ones(spark, said):
    from folioflow.functions import text

    df = spark.createDataFrame([(said,)], "b string")
    label = text.checkbox_label(text.visible_html(F.col("b")))
    row = df.select(forms._visible(F.col("b")).alias("v"), text.visible_html(F.col("b")).alias("w"), forms.option(text.visible_html(F.col("b")))["label"].alias("o"), F.when(label.isin(*forms.OPTIONS), label).alias("p")).first()
    assert row.v == row.w and row.o == row.p


def test_pieces_say_what_the_whole_says():
    """cut at the ends of rows, a text says the same as in one pass, also where cells and rows go over an end or are never closed."""
    r = random.Random(3)
    parts = ["<table>", "<thead>", "<tr>", "<TR>", "<tr x>", "</tr>", "</tr>", "</TR>", "<td>", "</td>", "<th a>", "</th>", "<td a='</tr>", "<td", "<tr", "x", "☒", "[ ] ", "Office", "Hospice:", "note", "&nbsp;", "<br>", "participating", "nonparticipating"]
    over = 0
    for _ in range(4000):
        html = "".join(r.choices(parts, k=r.randrange(30)))
        whole, pieces = forms._read(html), forms._pieces(html)
        over += len(pieces) == 1 and forms.ROW_END in html
        assert [(at + c[0], at + c[1], *c[2:]) for at, said in pieces for c in said.cells] == whole.cells
        assert forms._anchor(html) == whole.first and ",".join(s.told for _, s in pieces if s.told) == whole.told
        rows = forms._ROW.findall(html)
        assert forms._marked_options(html) == ([o for row in rows for o in forms._read(row).marked] if rows else [o[:2] for o in whole.options])
    assert over > 100


def test_texts_are_read_as_expressions_read_them(spark):
    """what Python says of a cell is what ``text.visible_html`` and ``option`` say."""
    from folioflow.functions import text

    r = random.Random(4)
    parts = ["x", "X", " ", "x ", "[x]", "[ ]", "[?] ", "☑", "□", "☒", "office", "Home health", "HOSPICE", "sKilled nursing facility", ":", " ", "\x1c", " ", "\n", "<b>", "<br/>", "&amp;", "&lt;", "&nbsp;", "İ", "é"]
    bodies = ["".join(r.choices(parts, k=r.randrange(6))) for _ in range(3000)]
    said = text.visible_html(F.col("b"))
    own = forms.option(said)
    for row in spark.createDataFrame([(b,) for b in bodies], "b string").select("b", said.alias("s"), own["label"].alias("l"), own["state"].alias("t"), forms._marked(F.lit("checked"), F.col("b")).alias("m")).collect():
        assert (forms._say(row.b), *forms._option_of(row.s), forms._put_mark("checked", row.b)) == (row.s, row.l, row.t, row.m)


def test_recovery_reads_each_text_once(spark):
    """readings pass one shuffle as codes, beside the anchors of what is asked; texts meet only what was found for them."""
    regions, readings = recovery._inputs(Tables(spark, SMALL))
    plan = forms.recover_forms(regions, readings, ["doc_id"], 3)._jdf.queryExecution().sparkPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1
    assert [sum(f"ArrowEvalPython [{name}(" in line for line in plan.splitlines()) for name in ("asked_anchor", "reading_of", "completed")] == [1, 1, 1]
    codes = [forms._code(forms._states(f"<td>{a}Office</td><td>Home</td><td>{b}Office</td>")) for a, b in (("[x] ", ""), ("[x] ", "[ ] "), ("", "[ ] "))]
    assert forms._agreed(codes[0], codes[1]) == {"office": ["checked", None], "home": [None]} and forms._agreed(codes[1], codes[2])["office"] == [None, "unchecked"]
