"""Fixed values of the controlled-document domain, and the settings of retrieval."""

from __future__ import annotations

from dataclasses import dataclass

# Statuses, document types, field orders and texts that results must carry.
STATUSES = ("Approved", "Effective", "Draft", "Obsolete", "Superseded")
RETRIEVABLE = ("Approved", "Effective")
DOC_TYPES = (
    "SOP", "Policy", "TrainingNote", "DeviationExample", "CalibrationNote", "Specification", "TechnicalNote",
)
FIELDS = ("doc_id", "doc_title", "doc_type", "version", "status", "effective_date", "department")
OUTCOMES = ("answer", "refusal")
STATES = ("mapped_cleanly", "excluded", "needs_review", "rejected")
REFUSAL_TEXT = "The retrieved documents do not contain enough information to answer this question."
REFUSAL_REASON = "refusal_no_supporting_documents"
LOW_SCORE_REASON = "low_top_score"

# Texts of a corpus' issues.
NO_METADATA_DIR = "metadata directory is required"
NO_SIDECARS = "at least one metadata YAML sidecar is required"
OUTSIDE = "source_file_path must stay inside the corpus directory"
TWO_CURRENT = (
    "more than one retrievable version for doc_id '%s' (versions: %s); exactly one Approved/Effective version may be retrievable"
)

# Words that don't count as terms of a question.
STOPWORDS = """
a an the of for to and or in on is are was were be been being this that these those
what which who whom how when where why do does did we you they it its our your their
with without within into onto from by as at if then than so such not no can could should
would will may might must have has had i me my them he she his her him us about over under
""".split()

# The constants of BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: The constant of reciprocal rank fusion.
FUSION_K = 60


@dataclass(frozen=True)
class RetrievalConfig:
    """top_k of 1 or more, score floor of 0 or more, least coverage of the best hit from 0 to 1."""

    method: str = "bm25"
    top_k: int = 5
    score_floor: float = 0.0
    min_top_coverage: float = 0.6

    def __post_init__(self):
        if self.method != "bm25":
            raise ValueError(f"unsupported retrieval method: {self.method}")
        if self.top_k < 1 or self.score_floor < 0 or not 0 <= self.min_top_coverage <= 1:
            raise ValueError("top_k, score_floor or min_top_coverage is out of range")

    def record(self) -> dict:
        return dict(vars(self))
