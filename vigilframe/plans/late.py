"""Attempt states under late events: every derived value is kept for as long as it holds.

``sweep`` applies the events of an attempt in the order in which they were received. What an event looks back at
(the view before it, the idle state before it, the last tab switch, the last led paste) changes only when
a later arrival is inserted between the two, so an insertion looks again at just the events whose value
changes: the next one of the chain, or those within the time bounds of a pattern up to the next event of the same
kind. Changes are added to running totals, with their sign; the two smallest quick leaves come from an ordered
list of those that hold. An attempt costs its events plus the changes that late ones cause, and gives one row per
event. Nothing is written between.

Rows come sorted by attempt and order of arrival, so a task holds the places of one attempt at a time; attempts
above ``HotKeys.hot_rows`` take the plain way in ``progressive``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vigilframe.config import PatternRules
from vigilframe.operators.normalize import event_flags

SECOND = 1_000_000
#: Rows that a worker holds ready before it hands them on.
HELD = 8192
TOTALS = (
    "paste_count",
    "tab_hidden_count",
    "idle_spike_count",
    "_question_sum",
    "questions_seen",
    "_first_us",
    "_newest_us",
    "event_count",
    "_sequences",
    "quick_leaves",
    "best_quick_us",
    "second_quick_us",
)
#: Kinds of events that something looks back at or forward to.
KINDS = ("is_paste", "is_tab_hidden", "is_idle_start", "is_idle_end", "is_question_enter", "is_question_leave")
Place = tuple[int, int]  # event time and arrival: the order of a timeline


class Chain:
    """Places of one kind of event, in order."""

    def __init__(self) -> None:
        self.at: list[Place] = []

    def add(self, place: Place) -> int:
        if not self.at or place > self.at[-1]:
            self.at.append(place)
            return len(self.at) - 1
        insort(self.at, place)
        return bisect_left(self.at, place)

    def before(self, place: Place) -> Place | None:
        i = bisect_left(self.at, place)
        return self.at[i - 1] if i else None

    def after(self, place: Place) -> Place | None:
        i = bisect_right(self.at, place)
        return self.at[i] if i < len(self.at) else None

    def between(self, low: Place, high: Place | None, until_us: int) -> list[Place]:
        """Places after ``low`` and before ``high``, no later than a time."""
        start = bisect_right(self.at, low)
        end = bisect_right(self.at, (until_us, 1 << 62))
        if high is not None:
            end = min(end, bisect_left(self.at, high))
        return self.at[start:end]


class Attempt:
    """The state of one attempt after each arrival."""

    def __init__(self, rules: PatternRules):
        self.fast = int(rules.fast_answer_s * SECOND)
        self.tab_to_paste = int(rules.tab_to_paste_s * SECOND)
        self.idle_to_tab = int(rules.idle_to_tab_s * SECOND)
        self.paste_to_leave = int(rules.paste_to_leave_s * SECOND)
        self.idle_to_leave = int(rules.idle_to_leave_s * SECOND)
        self.views, self.idles, self.hidden, self.idle_ends = Chain(), Chain(), Chain(), Chain()
        self.pastes, self.led, self.leaves = Chain(), Chain(), Chain()
        self.enters: dict[str, Chain] = {}
        self.leaves_of: dict[str, Chain] = {}
        self.entered: set[Place] = set()
        self.idle: set[Place] = set()
        self.question_of: dict[Place, str] = {}
        self.pairs: dict[Place, int] = {}
        self.spikes: set[Place] = set()
        self.sequences: set[Place] = set()
        self.quick: dict[Place, int] = {}
        self.quick_values: list[int] = []
        self.events = self.question_sum = 0
        self.first = self.newest = None

    def totals(self) -> tuple:
        quick = self.quick_values
        return (
            len(self.pastes.at),
            len(self.hidden.at),
            len(self.spikes),
            self.question_sum if self.pairs else None,
            len(self.pairs),
            self.first,
            self.newest,
            self.events,
            len(self.sequences),
            len(quick),
            quick[0] if quick else None,
            quick[1] if len(quick) > 1 else None,
        )

    def insert(self, t_us: int, arrival: int, kind: str | None, question: str | None) -> None:
        place = (t_us, arrival)
        self.events += 1
        self.first = t_us if self.first is None else min(self.first, t_us)
        self.newest = t_us if self.newest is None else max(self.newest, t_us)
        if kind is not None:
            getattr(self, kind)(place, question)

    # ---- what each kind of event changes ----

    def is_question_enter(self, place: Place, question: str | None) -> None:
        self.entered.add(place)
        self.viewed(place)
        if question is None:
            return
        own = self.enters.setdefault(question, Chain())
        own.add(place)
        if question in self.leaves_of:
            for leave in self.leaves_of[question].between(place, own.after(place), place[0] + self.fast):
                self.judge_quick(leave)

    def is_question_leave(self, place: Place, question: str | None) -> None:
        self.question_of[place] = question
        self.viewed(place)
        if question:
            self.leaves_of.setdefault(question, Chain()).add(place)
        self.leaves.add(place)
        self.judge_quick(place)
        self.judge_sequence(place)
        self.judge_sequence(self.leaves.after(place))

    def viewed(self, place: Place) -> None:
        self.views.add(place)
        self.judge_pair(place)
        self.judge_pair(self.views.after(place))

    def is_idle_start(self, place: Place, _: str | None) -> None:
        self.idle.add(place)
        self.idles.add(place)
        self.judge_spike(self.idles.after(place))

    def is_idle_end(self, place: Place, _: str | None) -> None:
        self.idles.add(place)
        self.judge_spike(place)
        self.judge_spike(self.idles.after(place))
        self.idle_ends.add(place)
        following = self.idle_ends.after(place)
        for leave in self.leaves.between(place, following, place[0] + self.idle_to_leave):
            self.judge_quick(leave)
        for paste in self.pastes.between(place, following, place[0] + self.idle_to_tab + self.tab_to_paste):
            self.judge_led(paste)

    def is_tab_hidden(self, place: Place, _: str | None) -> None:
        self.hidden.add(place)
        for paste in self.pastes.between(place, self.hidden.after(place), place[0] + self.tab_to_paste):
            self.judge_led(paste)

    def is_paste(self, place: Place, _: str | None) -> None:
        self.pastes.add(place)
        self.judge_led(place)

    # ---- values that hold now ----

    def judge_pair(self, view: Place | None) -> None:
        if view is None or view in self.entered:
            return
        before = self.views.before(view)
        took = view[0] - before[0] if before in self.entered else 0
        self.question_sum -= self.pairs.pop(view, 0)
        if took > 0:
            self.pairs[view] = took
            self.question_sum += took

    def judge_spike(self, idle: Place | None) -> None:
        if idle is None or idle in self.idle:
            return
        if self.idles.before(idle) in self.idle:
            self.spikes.add(idle)
        else:
            self.spikes.discard(idle)

    def judge_led(self, paste: Place) -> None:
        hidden, ended = self.hidden.before(paste), self.idle_ends.before(paste)
        led = (
            hidden is not None
            and ended is not None
            and paste[0] - hidden[0] <= self.tab_to_paste
            and hidden[0] - ended[0] <= self.idle_to_tab
        )
        i = bisect_left(self.led.at, paste)
        held = i < len(self.led.at) and self.led.at[i] == paste
        if led != held:
            if led:
                self.led.add(paste)
            else:
                del self.led.at[i]
            self.judge_sequence(self.leaves.after(paste))

    def judge_sequence(self, leave: Place | None) -> None:
        if leave is None:
            return
        led, before = self.led.before(leave), self.leaves.before(leave)
        if led is not None and (before is None or led > before) and leave[0] - led[0] <= self.paste_to_leave:
            self.sequences.add(leave)
        else:
            self.sequences.discard(leave)

    def judge_quick(self, leave: Place) -> None:
        question = self.question_of[leave]
        enter = self.enters[question].before(leave) if question and question in self.enters else None
        ended = self.idle_ends.before(leave)
        took = None
        if enter is not None and ended is not None and leave[0] - ended[0] <= self.idle_to_leave:
            took = max(leave[0] - enter[0], 0)
            took = took if took <= self.fast else None
        held = self.quick.pop(leave, None)
        if held is not None:
            del self.quick_values[bisect_left(self.quick_values, held)]
        if took is not None:
            self.quick[leave] = took
            insort(self.quick_values, took)


def sweep(events: DataFrame, key: tuple[str, ...], epoch: str, rules: PatternRules, after: int | None) -> DataFrame:
    """Totals of the prefix of every event, of attempts of bounded size.

    ``epoch`` numbers the instants that brought late events; the late ones of an instant are merged before any row
    of it is given. Rows up to the arrival ``after`` are not given.
    """
    kind = F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in KINDS])
    rows = event_flags(events).select(*key, "arrival", "t_us", kind.alias("kind"), "question_id", epoch, "_late")
    schema = ", ".join(
        [f"{c} {rows.schema[c].dataType.simpleString()}" for c in key] + ["arrival long", *[f"{c} long" for c in TOTALS]]
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = [*key, "arrival", *TOTALS]

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        merged: list[tuple] = []  # late events of an instant, whose state is that after the last of them
        now, state, instant = None, None, None

        def settle() -> None:
            totals = state.totals() if merged else ()
            out.extend((*m, *totals) for m in merged)
            merged.clear()

        for table in tables:
            columns = [table.column(i).to_pylist() for i in range(table.num_columns)]
            for *group, arrival, t_us, kind_, question, number, late in zip(*columns):
                if merged and (group != now or number != instant or not late):
                    settle()
                if group != now:
                    now, state = group, Attempt(rules)
                instant = number
                state.insert(t_us, arrival, kind_, question)
                if after is None or arrival > after:
                    if late:
                        merged.append((*group, arrival))
                    else:
                        out.append((*group, arrival, *state.totals()))
            if len(out) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out.clear()
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    order = [*key, epoch, F.col("_late").desc(), "arrival"]
    return rows.repartition(*key).sortWithinPartitions(*order).mapInArrow(batches, schema).select(*names)
