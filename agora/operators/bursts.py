"""Bursts of terms: an automaton whose states are rates of a term, and the cheapest way through it for each term's days.

State i expects the term in `scale` ** i times its overall share of the day's rows. Being in a state costs what a day's count is
unlikely there (binomial), and going up by one state costs `gamma` ln(days); going down is free. A burst is a run of days in a state of at least 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def costs(hits: np.ndarray, rows: np.ndarray, states: int, scale: float) -> np.ndarray:
    """The cost of each day in each state, less what is the same in all states."""
    share = hits.sum() / rows.sum()
    p = np.minimum(share * scale ** np.arange(states), 1 - 1e-9)
    return -(hits[:, None] * np.log(p) + (rows - hits)[:, None] * np.log1p(-p))


def cheapest(cost: np.ndarray, up: float) -> np.ndarray:
    """The states of least total cost, from state 0 on; of equal ways the one of lower states, from the last day back."""
    days, states = cost.shape
    move = up * np.maximum(0, np.arange(states)[None, :] - np.arange(states)[:, None])  # from, to
    total, back = move[0] + cost[0], np.zeros((days, states), np.int64)
    for d in range(1, days):
        way = total[:, None] + move
        back[d] = way.argmin(0)
        total = way.min(0) + cost[d]
    out = np.zeros(days, np.int64)
    out[-1] = total.argmin()
    for d in range(days - 1, 0, -1):
        out[d - 1] = back[d, out[d]]
    return out


def bursts(df: DataFrame, ts: str, term: str, states: int = 3, scale: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """(term, level, begin, end, n, weight): each maximal run of days at `level` or above; n its rows of the term; weight what it saves against level 0.

    A day counts if it has any row. Days without the term count as zeros. Rows without a time or a term count for no term.
    """
    rows = df.select(F.to_date(ts).alias("day"), F.col(term).cast("string").alias("term")).where("day is not null")
    counts = rows.groupBy("day", "term").agg(F.count("*").alias("n"))
    days = counts.groupBy("day").agg(F.sum("n").alias("rows"))
    calendar = days.orderBy("day").collect()  # a row for each day
    when, total = [r.day for r in calendar], np.array([r.rows for r in calendar], float)
    hits = counts.where("term is not null").groupBy("term").agg(F.collect_list(F.struct("day", "n")).alias("hits"))  # a day each, at most
    schema = "term string, level int, begin date, end date, n long, weight double"

    def run(batches):
        for pdf in batches:
            out = []
            for name, own in zip(pdf["term"], pdf["hits"], strict=True):
                seen = {h["day"]: h["n"] for h in own}
                got = np.array([seen.get(d, 0) for d in when], float)
                cost = costs(got, total, states, scale)
                path = cheapest(cost, gamma * np.log(max(len(when), 2)))
                saved = cost[:, 0] - cost[np.arange(len(path)), path]
                for level in range(1, states):
                    on = np.flatnonzero(np.diff(np.concatenate(([False], path >= level, [False]))))
                    out += [(name, level, when[a], when[b - 1], int(got[a:b].sum()), float(saved[a:b].sum())) for a, b in on.reshape(-1, 2).tolist()]
            yield pd.DataFrame(out, columns=["term", "level", "begin", "end", "n", "weight"])

    return hits.mapInPandas(run, schema)
