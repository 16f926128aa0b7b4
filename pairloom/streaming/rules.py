"""Rules that classify training-log lines, and the recovery parameters per error type."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Patterns, window sizes, messages and parameters of the monitored method.
COMPLETE_MARKERS = (
    "모델 저장 완료",
    "학습 완료",
    "training completed",
    "모델이 저장되었습니다",
    "saved model",
    "epoch 3/3",
    "100%|██████████|",
)
COMPLETE_TAIL_MARKERS = ("100%", "완료", "complete")
GPU_MEMORY_PATTERNS = (
    "out of memory",
    "cuda out of memory",
    "nvml",
    "runtimeerror: nvml_success",
    "cuda error",
)
CUDA_PATTERNS = ("cuda runtime error", "cuda driver error", "cuda initialization error")
IMPORT_EXACT = ("moduleNotFoundError",)
IMPORT_ANY_CASE = ("import error",)
GENERAL_PATTERNS = ("error", "exception", "traceback")
MESSAGE_PATTERNS = ("error", "exception")

COMPLETE_LINES = 100
COMPLETE_TAIL_LINES = 10
ERROR_LINES = 200
MESSAGE_LINES = 50
MESSAGE_CHARS = 100
PROGRESS_CHARS = 80
MAX_CONSECUTIVE_ERRORS = 3
POLL_SECONDS = 30

ERROR_MESSAGES = {
    "gpu_memory": "GPU 메모리 부족 에러 감지",
    "cuda": "CUDA 에러 감지",
    "import": "Import 에러 감지",
    "general": "에러 감지: ",
}
RECOVERY_OVERRIDES = {
    "gpu_memory": {"batch_size": "1", "K": "4"},
    "cuda": {"device": "cpu"},
}
BASE_PARAMETERS = {
    "data_version": "supervised_only",
    "epochs": "3",
    "batch_size": "2",
    "lr": "2e-5",
    "K": "8",
    "tau": "0.2",
    "use_hard_negative_mining": "True",
    "normalize_similarity": "True",
    "lora_r": "32",
    "lora_alpha": "64",
    "lora_dropout": "0.1",
    "max_len": "256",
    "device": "cuda",
}


@dataclass(frozen=True)
class Rule:
    """A hit is a line holding any pattern within the last `lines` lines of a log."""

    name: str
    any_case: tuple[str, ...]
    exact: tuple[str, ...]
    lines: int


@dataclass(frozen=True)
class RuleSet:
    complete: tuple[Rule, ...]
    errors: tuple[Rule, ...]
    """In order of precedence."""


MESSAGE_RULE = Rule("message", MESSAGE_PATTERNS, (), MESSAGE_LINES)

REFERENCE_RULES = RuleSet(
    complete=(
        Rule("complete", COMPLETE_MARKERS, (), COMPLETE_LINES),
        Rule("complete_tail", COMPLETE_TAIL_MARKERS, (), COMPLETE_TAIL_LINES),
    ),
    errors=(
        Rule("gpu_memory", (), GPU_MEMORY_PATTERNS, ERROR_LINES),
        Rule("cuda", (), CUDA_PATTERNS, ERROR_LINES),
        Rule("import", IMPORT_ANY_CASE, IMPORT_EXACT, ERROR_LINES),
        Rule("general", GENERAL_PATTERNS, (), ERROR_LINES),
    ),
)
"""The rules as first written: some patterns can only match an unusual case, any finished
progress bar counts as completion, and `cuda error` counts as a memory error."""


def _any_case(rule: Rule, drop: tuple[str, ...] = (), add: tuple[str, ...] = ()) -> Rule:
    patterns = tuple(p for p in rule.any_case + rule.exact if p not in drop)
    return replace(rule, any_case=patterns + add, exact=())


_memory, _cuda, _import, _general = REFERENCE_RULES.errors
CORRECTED_RULES = RuleSet(
    complete=(
        _any_case(REFERENCE_RULES.complete[0], drop=("epoch 3/3", "100%|██████████|")),
    ),
    errors=(
        _any_case(_memory, drop=("cuda error",)),
        _any_case(_cuda, add=("cuda error",)),
        _any_case(_import),
        _general,
    ),
)
"""Case-insensitive throughout, an explicit completion marker, `cuda error` is a CUDA error."""
