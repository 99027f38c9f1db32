"""Decision fidelity, privacy and synthesis of customer tables on Spark."""

from twinsight.operators.encoder import TableEncoder
from twinsight.operators.privacy import (
    deployment_gate,
    membership_inference_auc,
    novelty_rate,
    three_axis_report,
)
from twinsight.operators.scorers import PythonScorer, TreeScorer, apply_scorer, logistic_scorer
from twinsight.operators.split import stratified_split
from twinsight.operators.ssf import (
    CampaignEconomics,
    FidelityResult,
    Strategy,
    compare_candidates,
    default_strategy_family,
    ssf_score,
)
from twinsight.sources import load_clean, read_table
from twinsight.synth import SynthConfig, TableSynthesizer

__all__ = [
    "CampaignEconomics",
    "FidelityResult",
    "PythonScorer",
    "Strategy",
    "SynthConfig",
    "TableEncoder",
    "TableSynthesizer",
    "TreeScorer",
    "apply_scorer",
    "compare_candidates",
    "default_strategy_family",
    "deployment_gate",
    "load_clean",
    "logistic_scorer",
    "membership_inference_auc",
    "novelty_rate",
    "read_table",
    "ssf_score",
    "stratified_split",
    "three_axis_report",
]
