"""Run states: a machine for one run, and the check of many runs' histories in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.model import MOVES


class IllegalMove(ValueError):
    pass


class StateMachine:
    def __init__(self, state: str = "pending"):
        self.state = state

    def can(self, to: str) -> bool:
        return to in MOVES[self.state]

    def move(self, to: str) -> str:
        if not self.can(to):
            raise IllegalMove(f"{self.state} -> {to}")
        self.state = to
        return to

    @property
    def terminal(self) -> bool:
        return not MOVES[self.state]

    @property
    def active(self) -> bool:
        return self.state in ("running", "checkpoint", "resumed")

    def reset(self, state: str = "pending") -> None:
        self.state = state


def moves_table(df: DataFrame) -> DataFrame:
    """The legal moves as (prev_state, state), in the session of ``df``."""
    return df.sparkSession.createDataFrame([(a, b) for a, many in MOVES.items() for b in many], "prev_state string, state string")


def illegal_moves(df: DataFrame, run: str, state: str, *order: str) -> DataFrame:
    """Every move between consecutive states of a run, with ``legal``: run, order columns, prev_state, state, legal."""
    before = F.lag(state).over(Window.partitionBy(run).orderBy(*order))
    moves = df.select(run, *order, before.alias("prev_state"), F.col(state).alias("state")).where("prev_state is not null")
    legal = F.broadcast(moves_table(df).withColumn("_legal", F.lit(True)))  # 11 rows
    return moves.join(legal, ["prev_state", "state"], "left").select(run, *order, "prev_state", "state", F.coalesce("_legal", F.lit(False)).alias("legal"))
