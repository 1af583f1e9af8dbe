"""Page states over rounds of answers (C11): as a batch, one join a round, and as a stream, one state a page.

A page's blocks go through three rounds: verify, crop, quality. Each round asks about some blocks; an answer names the block and
the version that it has seen, and every change raises the version. An answer to another version is stale, two to one version
cancel each other, and a round that a page has behind it changes nothing, so answers may be delivered again.

blocks: by, id, type, text, status, confidence, has_box, reading_order, reason; turns: by, round (the rounds whose answers are in);
answers: by, round, id, version, action, confidence, text. Actions: accept, correct, reject, inspect; any other one is not conclusive.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .blocks import VERIFY_BELOW, VISUAL, needs_verification

ROUNDS = ("verify", "crop", "quality")
SURE = 0.85
MOST_CROPS = 8
# fixed value: literals that a page's recogniser often confuses
AMBIGUOUS = r"(?:#{2,}|(?i:\b(?:id|no|number)2(?=\s+[A-Z0-9][A-Z0-9_-]{2,}\b)))"
UNANSWERED, SEVERAL, UNSURE, INCONCLUSIVE, NO_BOX, LIMIT, REFUSED, UNCHANGED = "no answer", "several answers", "unsure correction", "inconclusive", "no box", "crop limit", "rejected by inspection", "nothing to correct"
BAD_EVIDENCE = "invalid confidence evidence"  # such a block is not verified by an accept alone


def start(blocks: DataFrame) -> DataFrame:
    """Blocks before the first round."""
    reason = F.col("reason") if "reason" in blocks.columns else F.lit(None).cast("string")
    return blocks.withColumns({"round": F.lit(0), "version": F.lit(0), "reason": reason, "recovered": F.lit(False)})


def asked(blocks: DataFrame, by: list[str], number: int, most: int = MOST_CROPS) -> DataFrame:
    """blocks with asked (the round asks about it) and over (it wanted a crop beyond the page's limit)."""
    alive = F.col("status") != "rejected"
    if number == 1:
        return blocks.withColumn("asked", alive & needs_verification()).withColumn("over", F.lit(False))
    if number == 3:
        return blocks.withColumn("asked", (F.col("status") == "needs_review") & F.col("has_box")).withColumn("over", F.lit(False))
    visual, inspect = F.col("type").isin(*VISUAL), F.col("status") == "inspect"
    wants = alive & F.col("has_box") & ~visual & (inspect | F.col("text").rlike(AMBIGUOUS))
    order = Window.partitionBy(*by, "_wants").orderBy(F.when(inspect, 0).otherwise(1), F.col("confidence").asc_nulls_last(), "reading_order", "id")
    ranked = blocks.withColumn("_wants", F.coalesce(wants, F.lit(False))).withColumn("_rank", F.row_number().over(order))
    out = ranked.withColumn("asked", alive & F.col("has_box") & (visual | (F.col("_wants") & (F.col("_rank") <= most))))
    return out.withColumn("over", inspect & ~F.col("asked")).drop("_wants", "_rank")


def _corrects() -> Column:
    """Whether a correction says something, and something else."""
    return (F.trim("_t") != "") & ~F.col("_t").eqNullSafe(F.col("text"))


def _outcome(number: int) -> Column:
    """status and reason that a round gives a block it asks about. Columns n, action, _c, _t: its answers of the right version."""
    pair = lambda status, reason=None: F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    action, sure = F.col("_action"), (F.col("_action") == "correct") & (F.col("_c") >= SURE)
    stays = F.when((F.col("status") == "inspect") | F.lit(number == 3), "needs_review").otherwise(F.col("status"))
    said = F.when((action == "accept") & F.col("reason").eqNullSafe(BAD_EVIDENCE), pair("needs_review", BAD_EVIDENCE)).when(action == "accept", pair("verified"))
    said = said.when(sure & _corrects(), pair("verified")).when(sure, pair(stays, UNCHANGED)).when(action == "correct", pair("needs_review", UNSURE))
    if number < 3:
        said = said.when(action == "reject", pair("needs_review", REFUSED))
    if number == 1:
        said = said.when(action == "inspect", F.when(F.col("has_box"), pair("inspect")).otherwise(pair("needs_review", NO_BOX)))
    return F.when(F.col("over"), pair("needs_review", LIMIT)).when(F.coalesce("_n", F.lit(0)) == 0, pair("needs_review", UNANSWERED)).when(F.col("_n") > 1, pair("needs_review", SEVERAL)).otherwise(F.coalesce(said, pair("needs_review", INCONCLUSIVE)))


def step(blocks: DataFrame, turns: DataFrame, answers: DataFrame, by: list[str], number: int, most: int = MOST_CROPS) -> DataFrame:
    """The blocks after one round; pages without its turn, or that are not just before it, stay as they are."""
    own = answers.where(F.col("round") == number).groupBy(*by, "id", F.col("version").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.first("action").alias("_action"), F.first("confidence").alias("_c"), F.first("text").alias("_t"))
    turn = turns.where(F.col("round") == number).select(*by).distinct().withColumn("_turn", F.lit(True))
    j = asked(blocks, by, number, most).join(turn, by, "left").withColumn("_now", F.coalesce("_turn", F.lit(False)) & (F.col("round") == number - 1))
    j = j.join(own.withColumnRenamed("_v", "version"), [*by, "id", "version"], "left").withColumn("_change", F.col("_now") & (F.col("asked") | F.col("over"))).withColumn("_o", _outcome(number))
    fixed = F.col("_change") & ~F.col("over") & (F.col("_n") == 1) & (F.col("_action") == "correct") & (F.col("_o.status") == "verified") & F.col("_o.reason").isNull() & _corrects() & (F.col("_c") >= SURE)
    return j.select(
        *by, "id", "type", F.when(fixed, F.col("_t")).otherwise(F.col("text")).alias("text"), F.when(F.col("_change"), F.col("_o.status")).otherwise(F.col("status")).alias("status"), F.when(fixed, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"),
        "has_box", "reading_order", F.when(F.col("_now"), number).otherwise(F.col("round")).alias("round"), (F.col("version") + F.col("_change").cast("int")).alias("version"), F.when(F.col("_change"), F.col("_o.reason")).otherwise(F.col("reason")).alias("reason"), F.coalesce(F.col("recovered") | fixed, F.col("recovered")).alias("recovered"),
    )


def judged(blocks: DataFrame, answers: DataFrame, by: list[str], number: int, most: int = MOST_CROPS) -> DataFrame:
    """What becomes of each answer of a round, given the blocks before it: applied, stale, unexpected, several or replayed."""
    b = asked(blocks, by, number, most).select(*by, "id", F.col("version").alias("_v"), "asked", F.col("round").alias("_round"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "id", "version"))
    j = answers.where(F.col("round") == number).withColumn("_n", n).join(b, [*by, "id"], "left")
    why = F.when(F.col("_v").isNull(), "unexpected").when(F.col("_round") >= number, "replayed").when(F.col("version") != F.col("_v"), "stale").when(~F.col("asked"), "unexpected").when(F.col("_n") > 1, "several").otherwise("applied")
    return j.select(*by, "round", "id", "version", why.alias("outcome"))


def run(blocks: DataFrame, turns: DataFrame, answers: DataFrame, by: list[str], most: int = MOST_CROPS) -> DataFrame:
    """C11: the blocks after all rounds whose turns are in."""
    out = blocks
    for number in range(1, len(ROUNDS) + 1):
        out = step(out, turns, answers, by, number, most)
    return out


# the same as a stream


def advance(blocks: list[dict], answers: list[dict], number: int, most: int = MOST_CROPS) -> list[dict]:
    """One page's blocks after one round; step() for one group."""
    by_version = Counter((a["id"], a["version"]) for a in answers)
    chosen = {(a["id"], a["version"]): a for a in answers}

    def wants(b: dict) -> bool:
        return b["status"] != "rejected" and b["has_box"] and b["type"] not in VISUAL and (b["status"] == "inspect" or re.search(AMBIGUOUS, b["text"] or "") is not None)

    order = sorted(filter(wants, blocks), key=lambda b: (b["status"] != "inspect", b["confidence"] is None, b["confidence"] or 0.0, b["reading_order"], b["id"]))
    first = {b["id"] for b in order[:most]}
    out = []
    for b in blocks:
        unsure = b["status"] == "needs_review" or (b["confidence"] is not None and b["confidence"] < VERIFY_BELOW)
        visual = b["status"] != "rejected" and b["has_box"] and b["type"] in VISUAL
        ask = {1: b["status"] != "rejected" and unsure, 2: visual or b["id"] in first, 3: b["status"] == "needs_review" and b["has_box"]}[number]
        over = number == 2 and b["status"] == "inspect" and not ask
        new = {**b, "round": number}
        if ask or over:
            n, a = by_version[b["id"], b["version"]], chosen.get((b["id"], b["version"]), {})
            action, reason = a.get("action"), None
            if over:
                status, reason = "needs_review", LIMIT
            elif n != 1:
                status, reason = "needs_review", SEVERAL if n else UNANSWERED
            elif action == "accept":
                status, reason = ("needs_review", BAD_EVIDENCE) if b["reason"] == BAD_EVIDENCE else ("verified", None)
            elif action == "correct" and (a["confidence"] or 0) >= SURE and (a["text"] or "").strip(" ") and a["text"] != b["text"]:
                status = "verified"
                new |= {"text": a["text"], "confidence": a["confidence"], "recovered": True}
            elif action == "correct" and (a["confidence"] or 0) >= SURE:
                status, reason = "needs_review" if number == 3 or b["status"] == "inspect" else b["status"], UNCHANGED
            elif action == "correct":
                status, reason = "needs_review", UNSURE
            elif action == "reject" and number < 3:
                status, reason = "needs_review", REFUSED
            elif action == "inspect" and number == 1:
                status, reason = ("inspect", None) if b["has_box"] else ("needs_review", NO_BOX)
            else:
                status, reason = "needs_review", INCONCLUSIVE
            new |= {"status": status, "reason": reason, "version": b["version"] + 1}
        out.append(new)
    return out


FIELDS = ("id", "type", "text", "status", "confidence", "has_box", "reading_order", "round", "version", "reason", "recovered")
BLOCK = "id string, type string, text string, status string, confidence double, has_box boolean, reading_order bigint, round int, version int, reason string, recovered boolean"


class PageRounds(StatefulProcessor):
    """Events of one page: a draft (round 0) with its blocks, and turns with their answers, in any order and any number of times."""

    def __init__(self, by: list[str], most: int = MOST_CROPS):
        self.by, self.most = by, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getValueState("blocks", "json string")
        self.waiting = handle.getMapState("waiting", "round int", "json string")  # turns that came before their round

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.blocks.get()[0]) if self.blocks.exists() else None
        done = held[0]["round"] if held else 0
        for batch in rows:
            for number, payload in zip(batch["round"], batch["payload"]):
                number = int(number)
                if number == 0 and held is None:
                    held = [{**b, "round": 0, "version": 0, "reason": b.get("reason"), "recovered": False} for b in json.loads(payload)]
                elif number > done and not self.waiting.containsKey((number,)):
                    self.waiting.updateValue((number,), (payload,))
        out = []
        while held and self.waiting.containsKey((done + 1,)):
            held = advance(held, json.loads(self.waiting.getValue((done + 1,))[0]), done + 1, self.most)
            self.waiting.removeKey((done + 1,))
            done += 1
            out += held
        if held:
            self.blocks.update((json.dumps(held),))
        if out:
            frame = pd.DataFrame(out)[list(FIELDS)]
            for name, value in zip(reversed(self.by), reversed(key)):
                frame.insert(0, name, value)
            yield frame

    def close(self) -> None:
        pass


def stream(events: DataFrame, by: list[str], most: int = MOST_CROPS) -> DataFrame:
    """C11 as a stream: each page's blocks after each round that its events complete. events: by, round (0: the draft), payload (JSON of
    the blocks or the answers). The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    kinds = dict(events.dtypes)
    return events.groupBy(*by).transformWithStateInPandas(PageRounds(by, most), ", ".join(f"{c} {kinds[c]}" for c in by) + f", {BLOCK}", "Update", "None")
