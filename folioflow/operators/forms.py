"""Form states: options of HTML forms, the agreement of two independent readings, and the merge of what they give.

A form is read into its options, each with its label, the number of earlier options of that label (its occurrence) and its state;
readings meet on label and occurrence. Texts are read a batch at a time, each in passes that grow with its length: it is cut into pieces
at the ends of rows, and what a short piece says is remembered, since forms of one print say the same again. A form is completed or merged
in its row; of a form its anchor, of a reading its anchor and a short code of its states go through the shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import joins, keep

# fixed values: option labels, the marks of a state, and the two labels of which one excludes the other
OPTIONS = (
    "participating", "nonparticipating", "outpatient", "planned inpatient", "emergent inpatient", "skilled nursing facility", "long-term services & supports/long-term care", "home health", "durable medical equipment",
    "diagnostic study", "hospice", "office visit", "personal care services", "hospital", "ambulatory surgery center", "office", "home", "independent lab", "nursing facility",
)
CHECKED, UNCHECKED = ("x", "☒", "☑", "✓", "✔"), ("☐", "□")
EITHER = ("participating", "nonparticipating")
CELL = r"(?is)<(td|th)(\s[^>]*)?>(.*?)</\1>"
ROW = r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"
MARK = r"(?U)^\s*(?:\[[xX ?]\]|[☑✓✔☐□]|[xX](?=\s+))\s*"
PLAIN = r"[^ -%'-;=-~]|\A | \z|  "  # what keeps a body from being its own visible text
SAYS_OPTION = r"(?iu)\A\s*(?:\[[xX ?]\]|[☑✓✔☐□]|[xX](?=\s))?\s*(?:" + "|".join(re.escape(o) for o in OPTIONS) + r")\s*:*\s*\z"  # of squashed texts; any option is among them
CLOSE = 5  # characters of a closing cell tag


_CELL, _ROW, _OPENS, _OPENS_ROW = re.compile("(?a)" + CELL), re.compile("(?a)" + ROW), re.compile(r"(?ai)<t[dh][\s>]"), re.compile(r"(?ai)<tr[\s>]")
_BREAK, _TAG = re.compile(r"(?ai)<br\s*/?>"), re.compile(r"<[^>]+>")
_BOX = re.compile(r" *(?:\[[xX ?]\]|[☑✓✔☐□]|[xX](?= )) *")  # of squashed texts
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # \s of MARK
_MARK = re.compile(MARK.removeprefix("(?U)").replace("\\s", f"[{_WHITE}]"))
_KNOWN = frozenset(OPTIONS)
_SHORT = 512  # characters; what longer pieces say is not remembered
_SIGNS, _STATES = {"checked": "+", "unchecked": "-", None: "?"}, {"+": "checked", "-": "unchecked"}
_LETTERS = {label: chr(ord("A") + i) for i, label in enumerate(OPTIONS)}


def _say(body: str) -> str:
    """``text.visible_html`` of a cell."""
    if "<" in body:
        body = _TAG.sub(" ", _BREAK.sub("\n", body))
    if "&" in body:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            body = body.replace(name, char)
    return " ".join(body.split())


def _option_of(said: str) -> tuple[str | None, str | None]:
    """``option`` of a visible text."""
    box = _BOX.match(said)
    label = " ".join((said[box.end() :] if box else said).lower().rstrip(":").split())
    if label not in _KNOWN:
        return None, None
    mark = box[0].strip(" ") if box else ""
    return label, "checked" if mark in ("[x]", "[X]", "x", "X", "☑", "✓", "✔") else "unchecked" if mark in ("[ ]", "☐", "□") else None


def _mark_of(said: str) -> str | None:
    return "checked" if said in CHECKED or said == "X" else "unchecked" if said in UNCHECKED else None


@dataclass(slots=True)
class Said:
    """What a piece of a text says."""

    cells: list[tuple[int, int, str, str | None, str | None]]  # start and end of the body, visible text, label, state
    options: list[tuple[str, str | None, int, int]]  # label, state, start, end of cells that are options
    marked: list[tuple[str, str | None]]  # label, state; a mark in the cell before an option is its state
    first: str | None  # the first text that is neither an option nor a mark
    told: str  # label=state of the options
    open: bool  # whether a cell is opened that is not closed


def _read(piece: str) -> Said:
    cells, options, marked, before, first, end, open_ = [], [], [], None, None, 0, False
    for m in _CELL.finditer(piece):
        open_ = open_ or _OPENS.search(piece, end, m.start()) is not None
        start, end = m.span(3)
        said = _say(piece[start:end])
        label, state = _option_of(said)
        mark = _mark_of(said)
        if label is not None:
            options.append((label, state, start, end))
            marked.append((label, state or before))
        elif first is None and said and mark is None:
            first = said
        cells.append((start, end, said, label, state))
        before = mark
    return Said(cells, options, marked, first, ",".join([f"{o[0]}={o[1] or '?'}" for o in options]), open_ or _OPENS.search(piece, end) is not None)


def _read_rows(piece: str) -> tuple[list[tuple[str, str | None]] | None, int]:
    """The marked options of the rows of a piece behind which a row ends, and the number of its rows; null options where one goes on."""
    piece, options, n, end = piece + ROW_END, [], 0, 0
    for m in _ROW.finditer(piece):
        options += _read(m[1]).marked
        n, end = n + 1, m.end()
    return (None if _OPENS_ROW.search(piece, end) else options), n


_read_known, _read_rows_known = lru_cache(1 << 12)(_read), lru_cache(1 << 12)(_read_rows)
ROW_END = "</tr>"


def _pieces(html: str) -> list[tuple[int, Said]]:
    """What a text says, piece by piece with the place of each; as a whole where a cell goes over the end of a row."""
    out, at = [], 0
    for part in html.split(ROW_END):
        said = _read_known(part) if len(part) <= _SHORT else _read(part)
        if said.open:
            return [(0, _read(html))]
        out.append((at, said))
        at += len(part) + len(ROW_END)
    return out


def _marked_options(html: str) -> list[tuple[str, str | None]]:
    """Options of a text's rows, or of the whole text where it has none."""
    *parts, last = html.split(ROW_END)
    options, n = [], 0
    if not _OPENS_ROW.search(last):
        for part in parts:
            own, rows = _read_rows_known(part) if len(part) <= _SHORT else _read_rows(part)
            if own is None:
                break
            options += own
            n += rows
        else:
            return options if n else _own_options(html)
    rows = _ROW.findall(html)  # a row goes over the end of another
    return [o for r in rows for o in _read(r).marked] if rows else _own_options(html)


def _own_options(html: str) -> list[tuple[str, str | None]]:
    return [o[:2] for _, said in _pieces(html) for o in said.options]


def _cells(html: str) -> Iterator[tuple[int, int, str, str | None, int | None, str | None]]:
    """Of each cell the start and the end of its body, what it says, its label, occurrence and state."""
    seen: dict[str, int] = {}
    for at, said in _pieces(html):
        for start, end, words, label, state in said.cells:
            n = None
            if label is not None:
                n = seen.get(label, 0)
                seen[label] = n + 1
            yield at + start, at + end, words, label, n, state


def _states(html: str, marks: bool = True) -> dict[str, list[str | None]]:
    """States of a form's options by label, in the order of their occurrences."""
    found: dict[str, list[str | None]] = {}
    for label, state in _marked_options(html) if marks else _own_options(html):
        if label in found:
            found[label].append(state)
        else:
            found[label] = [state]
    if marks and EITHER[0] in found and EITHER[1] in found:
        told = [(own, [s or ("unchecked" if i < len(other) and other[i] == "checked" else None) for i, s in enumerate(found[own])]) for own, other in ((EITHER[0], found[EITHER[1]]), (EITHER[1], found[EITHER[0]]))]
        found.update(told)
    return found


def _anchor(html: str) -> str | None:
    for part in html.split(ROW_END):  # mostly it stands in the first
        said = _read_known(part) if len(part) <= _SHORT else _read(part)
        if said.open:
            return _read(html).first
        if said.first is not None:
            return said.first
    return None


def _code(states: dict[str, list[str | None]]) -> str:
    """A letter for each label, in order, and a sign for each of its options; equal for equal states."""
    return "".join(sorted([_LETTERS[label] + "".join([_SIGNS[s] for s in own]) for label, own in states.items()]))


_LABEL_SIGNS = re.compile(r"([A-Z])([+?-]+)")


@lru_cache(1 << 12)
def _agreed(one: str, two: str) -> dict[str, list[str | None]]:
    """J16 of two readings' codes: states by label, null where they do not agree."""
    other = {letter: signs for letter, signs in _LABEL_SIGNS.findall(two)}
    return {OPTIONS[ord(letter) - ord("A")]: [_STATES.get(a) if a == b else None for a, b in zip(signs, other.get(letter, ""))] for letter, signs in _LABEL_SIGNS.findall(one)}


def _put_mark(state: str | None, body: str) -> str:
    """``_marked`` of a cell."""
    return {"checked": "[x] ", "unchecked": "[ ] "}.get(state, "[?] ") + _MARK.sub("", body, count=1).lstrip(_WHITE)


def _replaced(html: str, changes: list[tuple[int, int, str]]) -> str:
    """The text with parts (start, end, new) replaced."""
    out, at = [], 0
    for start, end, new in changes:
        out += (html[at:start], new)
        at = end
    return "".join([*out, html[at:]])


def _completed(html: str, states: dict[str, list[str | None]]) -> tuple[str, int]:
    """The text with the missing states of its options put in where states know them, and their number."""
    changes, seen = [], {}
    for at, said in _pieces(html):
        for label, state, start, end in said.options:
            n = seen.get(label, 0)
            seen[label] = n + 1
            if state is None and n < len(known := states.get(label, ())) and known[n] is not None:
                changes.append((at + start, at + end, _put_mark(known[n], html[at + start : at + end])))
    return (_replaced(html, changes), len(changes)) if changes else (html, 0)


def _merged(html: str | None, other: str | None) -> tuple[str | None, str, int]:
    """J17 of one form: text, status, number of the states and blanks that are now known."""
    theirs, states, changes, kinds = list(_cells(other or "")), {}, [], []
    for *_, label, _, state in theirs:
        if label is not None:
            states.setdefault(label, []).append(state)
    left = None
    for i, (start, end, said, label, n, state) in enumerate(_cells(html or "")):
        if label is not None:
            known = states.get(label, ())
            s = known[n] if n < len(known) else None
            conflict = state is not None and s is not None and state != s
            now = None if conflict else s or state
            kinds.append("conflict" if conflict else "unknown" if now is None else "known")
            changes.append((start, end, _put_mark(now, html[start:end])))
        elif said == "" and left is not None and left.endswith(":") and i < len(theirs) and theirs[i][2] != "" and left.casefold() == theirs[i - 1][2].casefold():
            kinds.append("known")
            changes.append((start, end, entities.escape(theirs[i][2])))
        left = said
    known, unknown = kinds.count("known"), kinds.count("unknown")
    status = "unchanged" if not kinds else "conflict" if "conflict" in kinds else "partial" if unknown and known else "ambiguous" if unknown else "resolved"
    return (_replaced(html, changes) if changes else html), status, known


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(sizes: list[int | None], fields: list[tuple[str, pa.DataType]], items: list[tuple]) -> pa.Array:
    """Arrays of structs of those sizes over the items; null where the size is."""
    offsets, at = [], 0
    for n in sizes:
        offsets.append(None if n is None else at)
        at += n or 0
    columns = [list(c) for c in zip(*items)] or [[] for _ in fields]
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def _visible(body: Column) -> Column:
    """The visible text of a cell; one pass over most."""
    return F.when(body.rlike(PLAIN), text.visible_html(body)).otherwise(body)


def option(said: Column) -> Column:
    """label and state of a cell's visible text; both null for a text that is no option. Batches of texts are read by ``_option_of``, which says the same."""
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("state"))

    def both(label: Column) -> Column:
        return F.when(label.isin(*OPTIONS), F.struct(label.alias("label"), text.checkbox_state(said).alias("state"))).otherwise(none)

    return F.when(said.rlike(SAYS_OPTION), text.bound(text.checkbox_label(said), both)).otherwise(none)


_OPTION = [("label", pa.string()), ("occurrence", pa.int32()), ("state", pa.string())]
_OF_CELL = [("cell", pa.int32()), ("body", pa.string()), ("said", pa.string()), *_OPTION]
OPTION_ROWS = T.ArrayType(T.StructType().add("label", "string").add("occurrence", "integer").add("state", "string"))
CELL_ROWS = T.ArrayType(T.StructType().add("cell", "integer").add("body", "string").add("said", "string").add("label", "string").add("occurrence", "integer").add("state", "string"))


def _options_of(html: pa.Array, marks: bool) -> pa.Array:
    sizes, items = [], []
    for said in _texts(html):
        if said is None:
            sizes.append(None)
            continue
        own = [(label, i, s) for label, states in _states(said, marks).items() for i, s in enumerate(states)]
        sizes.append(len(own))
        items += own
    return _lists(sizes, _OPTION, items)


@F.arrow_udf(OPTION_ROWS)
def _states_with_marks(html: pa.Array) -> pa.Array:
    return _options_of(html, True)


@F.arrow_udf(OPTION_ROWS)
def _states_without_marks(html: pa.Array) -> pa.Array:
    return _options_of(html, False)


def states_of(html: Column, marks: bool = True) -> Column:
    """label, occurrence, state of a form's options, label by label in the order of their occurrences.

    marks: read marks of their own cells, and take the other of two excluding options as unchecked where one is checked.
    """
    return (_states_with_marks if marks else _states_without_marks)(html)


@F.arrow_udf(T.ArrayType(T.StringType()))
def asked_anchor(html: pa.Array) -> pa.Array:
    """The anchor, not yet folded, of a form of two or more options with a missing state; else an empty array. An anchor is the first text that is
    neither an option nor a mark: what two readings of one form share."""
    def told(said: str) -> list[str]:
        states = _states(said).values()
        found = _anchor(said) if sum(map(len, states)) >= 2 and any(None in s for s in states) else None
        return [] if found is None else [found]

    return pa.array([[] if said is None else told(said) for said in _texts(html)], pa.list_(pa.string()))


@F.arrow_udf(T.StructType().add("anchor", "string").add("code", "string"))
def reading_of(html: pa.Array) -> pa.Array:
    """The anchor of a reading's region, not yet folded, and the code of its states; null for a text without a table."""
    said = [None if h is None or "<table" not in h.lower() else h for h in _texts(html)]
    columns = [[None if h is None else f(h) for h in said] for f in (_anchor, lambda h: _code(_states(h)))]
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["anchor", "code"])


@F.arrow_udf(T.StringType())
def said_options(html: pa.Array) -> pa.Array:
    """The options of a text in order with their own states, as label=state with commas between; ? for none."""
    told = lambda h: ",".join([said.told for _, said in _pieces(h) if said.told])
    return pa.array([None if h is None else told(h) for h in _texts(html)], pa.string())


def option_states(forms: DataFrame, key: list[str], column: str, marks: bool = True) -> DataFrame:
    """key, label, occurrence, state: one row an option of each form, as ``states_of`` reads them."""
    return forms.select(*key, F.inline(states_of(F.col(column), marks)))


def confirmed(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """States on which two readings agree."""
    on = [*key, "label", "occurrence"]
    return left.where("state IS NOT NULL").join(right.select(*on, F.col("state").alias("_r")), on).where(F.col("state") == F.col("_r")).drop("_r")


@F.arrow_udf(CELL_ROWS)
def cells_of(html: pa.Array) -> pa.Array:
    """cell, body, said, label, occurrence, state of every cell in order; occurrences count options of a label."""
    sizes, items = [], []
    for said in _texts(html):
        if said is None:
            sizes.append(None)
            continue
        own = [(i, said[start:end], words, label, n, state) for i, (start, end, words, label, n, state) in enumerate(_cells(said))]
        sizes.append(len(own))
        items += own
    return _lists(sizes, _OF_CELL, items)


def numbered_cells(forms: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, cell, body, said, label, occurrence, state of every cell, as ``cells_of`` reads them."""
    return forms.select(*key, F.inline(cells_of(F.col(column))))


def _with_bodies(html: Column, new) -> Column:
    """The text with the body new(cell number) in place of a cell's own where that is not null."""
    def piece(gaps: Column):
        def at(w: Column, i: Column) -> Column:
            cell = lambda n: F.when(n.isNull(), w).otherwise(F.concat(F.substring(w, F.lit(1), F.instr(w, ">")), n, F.substring(w, F.length(w) - CLOSE + 1, F.lit(CLOSE))))
            return F.concat(text.bound(new(i), cell), F.get(gaps, i + 1))

        return at

    whole = F.regexp_extract_all(html, F.lit(CELL), F.lit(0))
    put = lambda ws, gaps: F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(ws, piece(gaps)), ""))
    return text.bound(whole, lambda ws: F.when(F.size(ws) > 0, text.bound(F.split(html, CELL), lambda gaps: put(ws, gaps))).otherwise(html))


def with_cells(html: Column, changed: Column) -> Column:
    """The text with the bodies of some cells replaced. changed: map of cell number to body."""
    return text.bound(changed, lambda c: _with_bodies(html, lambda i: F.try_element_at(c, i)))


def _marked(state: Column, body: Column) -> Column:
    sign = F.when(state == "checked", "[x] ").when(state == "unchecked", "[ ] ").otherwise("[?] ")
    return F.concat(sign, F.regexp_replace(F.regexp_replace(body, MARK, ""), r"(?U)^\s+", ""))


def _put(forms: DataFrame, key: list[str], column: str, changes: DataFrame) -> DataFrame:
    """forms with the changed cells (key, cell, new) put into column."""
    gathered = changes.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("cell", "new"))).alias("_new"))
    j = forms.join(gathered, key, "left")
    return j.withColumn(column, F.when(F.col("_new").isNull(), F.col(column)).otherwise(with_cells(F.col(column), F.col("_new")))).drop("_new")


def merge_states(forms: DataFrame, states: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """forms with the missing states of their options put in, and n_resolved, the number of them. states: key, label, occurrence, state."""
    s = states.select(*key, "label", "occurrence", F.col("state").alias("_s"))
    changes = numbered_cells(forms, key, column).where("label IS NOT NULL AND state IS NULL").join(s, [*key, "label", "occurrence"]).where(F.col("_s").isNotNull()).select(*key, "cell", _marked(F.col("_s"), F.col("body")).alias("new"))
    n = changes.groupBy(*key).agg(F.count(F.lit(1)).alias("n_resolved"))
    return _put(forms, key, column, changes).join(n, key, "left").withColumn("n_resolved", F.coalesce("n_resolved", F.lit(0)))


@F.arrow_udf(T.StructType().add("text", "string").add("n_resolved", "long"))
def completed(html: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """A form's text with the missing states that two readings' codes agree on, and their number; null without a text."""
    done = [(None, None) if h is None else _completed(h, _agreed(a, b)) for h, a, b in zip(_texts(html), _texts(one), _texts(two))]
    columns = [list(c) for c in zip(*done)] or [[], []]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()))], names=["text", "n_resolved"])


@F.arrow_udf(T.StructType().add("text", "string").add("status", "string").add("n", "long"))
def merged_text(html: pa.Array, other: pa.Array) -> pa.Array:
    columns = [list(c) for c in zip(*map(_merged, _texts(html), _texts(other)))] or [[], [], []]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["text", "status", "n"])


def merge_forms(forms: DataFrame, key: list[str], column: str = "text", other: str = "recovered") -> DataFrame:
    """Forms merged with another reading: states that either gives and neither denies, and blank cells whose left neighbour is one label in both.

    Adds merge_status (conflict, partial, ambiguous, resolved, unchanged) and n_merged, the states and blanks that are now known. Each form
    is merged in its row.
    """
    rest = [c for c in forms.columns if c not in key]
    whole = forms.withColumn("_m", merged_text(column, other))
    return whole.select(*key, *[F.col("_m.text").alias(c) if c == column else F.col(c) for c in rest], F.col("_m.status").alias("merge_status"), F.col("_m.n").alias("n_merged"))


def recover_forms(regions: DataFrame, readings: DataFrame, by: list[str], most_pages: int, fine: DataFrame | None = None, per_page: int = 3) -> DataFrame:
    """Forms with missing states, completed by what two readings of their pages agree on; what stays open may be merged with a fine reading.

    regions: by, page, region_id, type, text; readings: by, page, reading (1 or 2), content (one row a region that the reading found; an
    unread page has none); fine: by, page, region_id, recovered. The first ``most_pages`` pages of a document with such forms are read again.
    Adds status and n_resolved. Statuses: complete (nothing to ask), deferred, ambiguous (its anchor is not alone on the page), unavailable
    (a reading lacks the page), unaligned (a reading has not exactly one form of that anchor), disagreed, unchanged, resolved. With fine also
    merge_status and n_merged: those of the ``per_page`` first forms a page that are still open, else null.
    """
    key = [*by, "page", "region_id"]
    forms = regions.where(F.col("type").isin("table", "form"))
    # what goes through windows is small: of a form its anchor, of a reading its anchor and code
    asked = forms.select(*key, F.explode(asked_anchor("text")).alias("_a")).withColumn("anchor", text.folded(F.col("_a"))).drop("_a")
    asked = asked.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("page")))
    read = readings.select(*by, "page", "reading", reading_of("content").alias("_r")).select(*by, "page", "reading", text.folded(F.col("_r.anchor")).alias("anchor"), F.col("_r.code").alias("_code"))
    both = asked.withColumn("_asked", F.lit(True)).unionByName(read, allowMissingColumns=True)
    page, place = Window.partitionBy(*by, "page"), Window.partitionBy(*by, "page", "anchor")
    of = lambda r: F.when(F.count(F.when(F.col("reading") == r, F.col("_code"))).over(place) == 1, F.max(F.when(F.col("reading") == r, F.col("_code"))).over(place)).alias(f"_r{r}")
    met = both.select(*key, "_asked", "_rank", "reading", F.count("_asked").over(place).alias("_same"), of(1), of(2))
    met = met.withColumn("_readings", F.min("reading").over(page) < F.max("reading").over(page)).where("_asked")
    why = (
        F.when(F.col("_rank") > most_pages, "deferred").when(F.col("_same") > 1, "ambiguous").when(~F.coalesce("_readings", F.lit(False)), "unavailable")
        .when(F.col("_r1").isNull() | F.col("_r2").isNull(), "unaligned")
    )
    told = met.select(*key, "_asked", why.alias("_why"), F.when(why.isNull(), F.col("_r1")).alias("_r1"), F.when(why.isNull(), F.col("_r2")).alias("_r2"))
    rest = [c for c in forms.columns if c not in key and c != "text"]
    merged = forms.join(told, key, "left").withColumn("_m", completed(F.when(F.col("_r1").isNotNull(), F.col("text")), "_r1", "_r2"))
    status = F.when(F.col("_asked").isNull(), "complete").when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_m.n_resolved") > 0, "resolved").when(F.col("_r1") != F.col("_r2"), "disagreed").otherwise("unchanged")
    out = merged.select(*key, *rest, F.coalesce("_m.text", "text").alias("text"), status.alias("status"), F.coalesce("_m.n_resolved", F.lit(0)).cast("bigint").alias("n_resolved"))
    if fine is None:
        return out
    out = keep.kept(out)
    ranked = out.withColumn("_s", states_of(F.col("text"))).where(F.exists("_s", lambda s: s["state"].isNull())).withColumn("_priority", F.when(F.size("_s") >= 2, 0).when(F.col("type") == "form", 1).otherwise(2))
    chosen = joins.capped_topk(ranked, [*by, "page"], ["_priority", "page", "region_id"], per_page, 1 << 30, by)
    merged = merge_forms(chosen.select(*key, "text").join(fine, key), key).select(*key, F.col("text").alias("_text"), "merge_status", "n_merged")
    return out.join(merged, key, "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
