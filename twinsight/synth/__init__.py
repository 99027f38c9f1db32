"""Conditional diffusion synthesizer, trained data-parallel and sampled in parallel on Spark."""

from twinsight.synth.config import SynthConfig
from twinsight.synth.generator import TableSynthesizer

__all__ = ["SynthConfig", "TableSynthesizer"]
