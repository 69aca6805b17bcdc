"""Pipelines: builder, run state, checkpoints, runner, project settings."""

from quillflow.plans.builder import Pipeline, PipelineBuilder, Step, pipeline
from quillflow.plans.checkpoint import CheckpointTree, count_by_state, first_open, tree_order
from quillflow.plans.runner import Runner, dead_letters, inspect_run, list_runs
from quillflow.plans.state import IllegalMove, StateMachine, illegal_moves

__all__ = ["CheckpointTree", "IllegalMove", "Pipeline", "PipelineBuilder", "Runner", "StateMachine", "Step", "count_by_state", "dead_letters", "first_open", "illegal_moves", "inspect_run", "list_runs", "pipeline", "tree_order"]
