"""Online choice of layouts: folds over the windows, in order. Each takes and returns a few rows a window."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "window_id long, chosen_candidate_id string, layout_label string, query_cost double, movement_cost double, switched boolean"


def _fold(families: DataFrame, step: Callable[[pd.DataFrame], list], schema: str, run: str | None = None) -> DataFrame:
    """One ordered pass over the windows of each run (of the whole table if runs are not named).

    The candidates of a window are few; a run is as long as its windows, and runs go to tasks of their own.
    """
    rows = families if run else families.withColumn("_run", F.lit(0))
    names = [part.split()[0] for part in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(step(pdf.sort_values(["window_id", "ord"], kind="stable")), columns=names)
        return out.assign(**{run: pdf[run].iloc[0]}) if run else out

    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(0))
    return rows.groupBy(run or "_run").applyInPandas(one, schema + (f", {run} long" if run else ""))


def greedy(families: DataFrame, alpha: float = 1.0, threshold: float = 0.0, sticky: bool = False, run: str | None = None, by_state: bool = False) -> DataFrame:
    """Switch events of the cost-aware greedy policy, or of the sticky one.

    The first window takes `base`, or the cheapest. Staying means the same label. A candidate's score adds alpha
    times its movement if its id (with by_state: its label) is not the previous one's; greedy moves if the best
    score plus the threshold is below staying, sticky if the best candidate is another label and its query cost
    is more than the threshold below. A switch pays the chosen candidate's movement cost.
    """

    def step(pdf: pd.DataFrame) -> list:
        events, previous = [], None
        for window, group in pdf.groupby("window_id", sort=True):
            options = list(group.itertuples())
            if previous is None:
                base = [o for o in options if o.layout_label == "base"]
                chosen = base[0] if base else min(options, key=lambda o: (o.query_cost, o.candidate_id))
            else:
                name = "layout_label" if by_state else "candidate_id"

                def score(o, previous=previous, name=name):
                    return o.query_cost + (alpha * o.movement_cost if getattr(o, name) != getattr(previous, name) else 0.0)

                stay = min(options, key=lambda o: (o.layout_label != previous.layout_label, o.query_cost, o.candidate_id))
                best = min(options, key=lambda o: (score(o), o.candidate_id))
                if sticky:
                    move = best.layout_label != stay.layout_label and stay.query_cost - best.query_cost > threshold
                else:
                    move = score(best) + threshold < score(stay)
                chosen = best if move else stay
            switched = previous is not None and previous.layout_label != chosen.layout_label
            events.append((window, chosen.candidate_id, chosen.layout_label, chosen.query_cost, chosen.movement_cost if switched else 0.0, switched))
            previous = chosen
        return events

    return _fold(families, step, EVENT, run)


def drawn(weight: np.ndarray, number: int, seed: int) -> int:
    """A place with probability by weight, from a hash of the draw's number: runs can be repeated and resumed."""
    u = ((number * 2654435761 + seed * 40503) % 1000003 + 1) / 1000005.0
    return int(np.searchsorted(np.cumsum(weight), u * weight.sum()))


class CounterState:
    """The counter policy's memory: costs by state since each was last left, and the current state."""

    def __init__(self, alpha: float, seed: int):
        if alpha <= 0:
            raise ValueError("alpha is positive")
        self.alpha, self.seed, self.seen = alpha, seed, 0
        self.counter: dict[str, float] = {}
        self.current: str | None = None

    def window(self, options: list[tuple[str, str, float]]) -> tuple[str, float, bool]:
        """(candidate, query cost, switched) for one window's (candidate, state, cost)."""
        self.seen += 1
        for _, state, cost in options:
            self.counter[state] = self.counter.get(state, 0.0) + cost
        states = {state: (name, cost) for name, state, cost in options}
        if self.current not in states:
            self.current = options[0][1]
            return options[0][0], options[0][2], False
        before = self.current
        if self.counter[before] > self.alpha:
            weight = np.array([max(0.0, (self.alpha - self.counter[s]) / self.alpha) for _, s, _ in options])
            if weight.sum() > 0:
                self.current = options[drawn(weight, self.seen, self.seed)][1]
            else:
                self.current = min(options, key=lambda o: (self.counter[o[1]], o[0]))[1]
            if self.current != before:
                self.counter[before] = 0.0
        name, cost = states[self.current]
        return name, cost, self.current != before


def counter(families: DataFrame, alpha: float, seed: int = 0, run: str | None = None) -> DataFrame:
    """Switch events of the counter policy: stay until the state's counter passes alpha, then draw by what is left."""

    def step(pdf: pd.DataFrame) -> list:
        state, events = CounterState(alpha, seed), []
        for window, group in pdf.groupby("window_id", sort=True):
            label = dict(zip(group["candidate_id"], group["layout_label"], strict=True))
            name, cost, switched = state.window(list(zip(group["candidate_id"], group["layout_label"], group["query_cost"], strict=True)))
            events.append((window, name, label[name], cost, alpha if switched else 0.0, switched))
        return events

    return _fold(families, step, EVENT, run)


class PhasedCounter:
    """The counter policy by phases: full counters are out, and a phase ends when all are full.

    A new phase resets the counters and admits states that came meanwhile at the median. The next state is drawn
    with probability by how far below the worst its estimate is, to the power tau; equal estimates are drawn evenly.
    """

    def __init__(self, states: list[str], alpha: float, tau: float = 1.0, smoothing: float = 1e-3, lag: int = 0, seed: int = 0):
        self.states, self.alpha, self.tau, self.smoothing, self.lag = list(states), alpha, tau, smoothing, lag
        self.seed, self.drawn, self.counter, self.waiting = seed, 0, {s: 0.0 for s in states}, {}
        self.current = self.serving = self.states[0]
        self.countdown, self.estimate = -1, dict(self.counter)

    def add(self, state: str) -> None:
        self.waiting[state] = float(np.median(list(self.counter.values()))) if self.counter else 0.0

    def query(self, cost: dict[str, float]) -> tuple[str, bool]:
        """(the serving state, whether another was chosen) after one query's costs."""
        self.countdown -= 1
        for held in (self.counter, self.waiting):
            for s in held:
                held[s] += cost.get(s, 0.0)
        chosen = self.counter[self.current] >= self.alpha and self._choose()
        if self.countdown == 0 or (chosen and not self.lag):
            self.serving = self.current
        return self.serving, bool(chosen)

    def _choose(self) -> bool:
        open_states = [s for s in self.states if self.counter[s] < self.alpha]
        if open_states:
            self.estimate = dict(self.counter)
        else:
            self.estimate = dict(self.counter) | self.waiting
            self.states += [s for s in self.waiting if s not in self.states]
            self.waiting, self.counter = {}, {s: 0.0 for s in self.states}
            well = self.estimate[self.current] <= np.mean(list(self.estimate.values())) + self.smoothing
            open_states = [self.current] if well else self.states
        c = np.array([self.estimate[s] for s in open_states]) + self.smoothing
        w = (c.max() - c) / ((c.max() - c).sum() + self.smoothing)
        total = (w**self.tau).sum()
        p = w**self.tau / total if total > 0 else np.full(len(c), 1 / len(c))
        self.drawn += 1
        new = open_states[drawn(p, self.drawn, self.seed)]
        moved, self.current = new != self.current, new
        if moved:
            self.countdown = self.lag
        return moved


def phased(costs: DataFrame, alpha: float, tau: float = 1.0, lag: int = 0, seed: int = 0, run: str | None = None) -> DataFrame:
    """(window_id, state, switched): the phased counter policy over windows of (state, cost), states as in the first window."""

    def step(pdf: pd.DataFrame) -> list:
        policy, out = None, []
        for window, group in pdf.groupby("window_id", sort=True):
            cost = dict(zip(group["state"].tolist(), group["cost"].tolist(), strict=True))
            policy = policy or PhasedCounter(sorted(cost), alpha, tau, lag=lag, seed=seed)
            out.append((window, *policy.query(cost)))
        return out

    return _fold(costs, step, "window_id long, state long, switched boolean", run)


def work_function(costs: DataFrame, alpha: float, run: str | None = None) -> DataFrame:
    """(window_id, state, work, best): work = min(own, smallest + alpha) + cost; the first state starts at 0, others at alpha."""

    def step(pdf: pd.DataFrame) -> list:
        opt: dict[int, float] = {}
        out = []
        for window, group in pdf.groupby("window_id", sort=True):
            cost = dict(zip(group["state"], group["cost"], strict=True))
            if not opt:
                opt = {s: 0.0 if i == 0 else alpha for i, s in enumerate(sorted(cost))}
            low = min(opt.values())
            # a state that comes later is reached from the cheapest
            opt = {s: min(opt.get(s, low + alpha), low + alpha) + c for s, c in cost.items()}
            best = min(opt, key=lambda s: (round(opt[s], 9), s))
            out += [(window, s, opt[s], s == best) for s in sorted(opt)]
        return out

    return _fold(costs, step, "window_id long, state long, work double, best boolean", run)


def regret(costs: DataFrame, alpha: float, factor: float = 1.0, run: str | None = None) -> DataFrame:
    """(window_id, state, switched): move to the first state whose summed cost is 0.2 * factor * alpha below the current's; sums then start over."""
    limit = 0.2 * factor * alpha

    def step(pdf: pd.DataFrame) -> list:
        total: dict[int, float] = {}
        current, out = None, []
        for window, group in pdf.groupby("window_id", sort=True):
            current, moved = (min(group["state"]) if current is None else current), False
            for s, c in sorted(zip(group["state"], group["cost"], strict=True)):
                total[s] = total.get(s, 0.0) + c
                if total.get(current, 0.0) - total[s] >= limit and s != current:
                    current, moved, total = s, True, {}
                    break
            out.append((window, current, moved))
        return out

    return _fold(costs, step, "window_id long, state long, switched boolean", run)


def summary(events: DataFrame) -> DataFrame:
    """One row of totals over switch events."""
    return events.agg(
        F.sum("query_cost").alias("total_query_cost"),
        F.sum("movement_cost").alias("total_movement_cost"),
        F.sum(F.col("query_cost") + F.col("movement_cost")).alias("total_cost"),
        F.count_if("switched").alias("switch_count"),
        F.count("*").alias("window_count"),
    )


def schedule_tables(events: DataFrame, prefix: str, index: str = "") -> DataFrame:
    """(window_id, layout, table_name): the table that serves each window."""
    name = F.concat(F.lit(f"{prefix}_window_"), F.col("window_id").cast("string"))
    return events.select("window_id", name.alias("layout"), F.concat(name, F.lit(f"_{index}" if index else "")).alias("table_name"))
