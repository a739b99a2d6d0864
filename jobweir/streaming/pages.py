"""Page sets as they arrive: a keyed state that closes each set once.

A run of a company's list comes as pages in any order, some of them again, some
late. The state of a run holds what tells how the list ends: of each page its
offset, status, entries and total, and its body until the run closes. A run
closes when every page up to its end is there, at a failure or a lost list that
ends it whatever else comes, or when nothing has come for ``timeout`` of event
time (its pages are then all there is, and closed_by says so); then it gives the pages that ``assemble_pages`` keeps, and its outcome.
What comes for it after that is dropped while the state remembers the run, and
by the watermark afterwards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IN = "kind string, slug string, run string, fetched_at timestamp, http_status int, page_offset int, n_entries int, total bigint, body string"
OUT = "kind string, slug string, run string, outcome string, closed_by string, page_offset int, body string"
STATE = "runs binary"
#: Runs are dealt to so many states by their hash: a call for each run would cost
#: more than its work.
GROUPS = 512


class Verdict(NamedTuple):
    outcome: str
    closed_by: str
    kept: list[int]


def verdict(pages: dict[int, tuple], limit: int, total_from: str, over: bool) -> Verdict | None:
    """What the pages so far (offset: status, entries, total) tell of a run; None
    while it is open, that is while a page before its end has not come. over:
    nothing more will come, so the pages that came are all there is."""
    kept, first = [], pages[min(pages)] if pages else None
    for i, at in enumerate(sorted(pages)):
        if at != i * limit and not over:
            return None
        status, n, total = pages[at]
        bound = total if total_from == "each" else first[2]
        if status == 404:
            return Verdict("stale" if at == 0 else "ok", "lost", kept)
        if not 200 <= status < 300:
            return Verdict("failed", "failure", [])
        if not n:
            return Verdict("ok", "empty", kept)
        kept.append(at)
        if (total_from == "each" or bound > 0) and at + limit >= bound:
            return Verdict("ok", "total", kept)
    return Verdict("ok", "timeout", kept) if over else None


def page_sets(pages: DataFrame, limit: int, total_from: str = "each", late: str = "10 minutes", timeout: str = "30 minutes") -> DataFrame:
    """A stream of OUT rows from a stream of pages (IN): one for each page that is
    kept of a run that closes, or a single one without a page where none is.

    A page that comes again before its run closes replaces the earlier one if it
    was fetched later. Runs are told apart by kind, slug and run.
    """
    wait_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def closing(held: dict, over: bool) -> tuple[Verdict | None, list]:
        found = verdict({o: (r[1], r[2], r[3]) for o, r in held.items()}, limit, total_from, over)
        if found is None:
            return None, []
        return found, [(found.outcome, found.closed_by, o, held[o][4]) for o in found.kept] or [(found.outcome, found.closed_by, None, None)]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # a run is held as its deadline and its pages: offset -> fetched at, status, entries, total, body; as None once closed
        runs: dict[tuple, list] = {}
        if state.exists:
            for run, deadline, pages_ in json.loads(zlib.decompress(state.get[0])):
                runs[tuple(run)] = [deadline, None if pages_ is None else {p[0]: p[1:] for p in pages_}]
        newest: dict[tuple, int] = {}
        if not state.hasTimedOut:
            for df in batches:
                at = df["fetched_at"].to_numpy("datetime64[ms]").astype("int64").tolist()
                numbers = (df[c].fillna(0).astype("int64").tolist() for c in ("page_offset", "http_status", "n_entries", "total"))
                named = zip(df["kind"].tolist(), df["slug"].tolist(), df["run"].tolist())
                for run, at, offset, status, n, total, body in zip(named, at, *numbers, df["body"].tolist()):
                    newest[run] = max(newest.get(run, 0), at)
                    held = runs.setdefault(run, [0, {}])[1]
                    if held is None:
                        continue
                    old = held.get(offset)
                    if old is None or at > old[0]:
                        held[offset] = (at, status, n, total, body)
        watermark, rows = state.getCurrentWatermarkMs(), []
        for run, at in newest.items():
            if runs[run][1] is not None:
                found, out = closing(runs[run][1], False)
                if found is not None:
                    runs[run][1] = None
                    rows += [(*run, *r) for r in out]
            runs[run][0] = max(at, watermark) + wait_ms
        for run in [r for r, (deadline, _) in runs.items() if deadline <= watermark and r not in newest]:
            held = runs.pop(run)[1]
            if held is not None:
                rows += [(*run, *r) for r in closing(held, True)[1]]
        if runs:
            packed = json.dumps([(run, deadline, held and [(o, *p) for o, p in held.items()]) for run, (deadline, held) in runs.items()])
            state.update((zlib.compress(packed.encode(), 1),))
            state.setTimeoutTimestamp(min(deadline for deadline, _ in runs.values()))
        else:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            out["page_offset"] = out["page_offset"].astype("Int32")
            yield out

    return (
        pages.withWatermark("fetched_at", late)
        .where(F.col("kind").isNotNull() & F.col("slug").isNotNull() & F.col("run").isNotNull())
        .withColumn("_group", F.pmod(F.xxhash64("kind", "slug", "run"), F.lit(GROUPS)))
        .groupBy("_group")
        .applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
