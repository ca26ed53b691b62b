"""Fixed values that must equal the evaluated system's for results to match.

Everything below is data (lookup tables, constants, templates), stated plainly and kept
together.  Operators take these as default parameters; callers may pass their own.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the evaluated system; do not edit to make tests pass)
# ---------------------------------------------------------------------------

# Task registry: input column, label column, label map, prompt template.
TASK_REGISTRY = {
    "classification": {
        "input_col": "text",
        "label_col": "label",
        "label_map": {0: "World", 1: "Sports", 2: "Business", 3: "Technology"},
        "prompt_template": (
            "Classify this news article into exactly one category "
            "(World / Sports / Business / Technology):\n{text}\nCategory:"
        ),
    },
    "ner": {
        "input_col": "tokens",
        "label_col": "ner_tags",
        "label_map": None,
        "prompt_template": (
            "Extract named entities (PER=person, ORG=organisation, "
            "LOC=location, MISC=miscellaneous) from this text:\n{text}\nEntities:"
        ),
    },
    "summarization": {
        "input_col": "article",
        "label_col": "highlights",
        "label_map": None,
        "prompt_template": "Summarize the following news article in 2-3 sentences:\n{text}\nSummary:",
    },
    "financial_sentiment": {
        "input_col": "sentence",
        "label_col": "label",
        "label_map": {0: "negative", 1: "neutral", 2: "positive"},
        "prompt_template": (
            "Classify the sentiment of this financial statement "
            "(negative / neutral / positive):\n{text}\nSentiment:"
        ),
    },
    "code_generation": {
        "input_col": "text",
        "label_col": "code",
        "label_map": None,
        "prompt_template": "Complete the following Python function:\n{text}\nSolution:",
    },
}

# Prompt input is cut to this many characters before templating.
PROMPT_TRUNCATE_CHARS = 400

# Financial sentiment: raw label word -> id.
FINANCIAL_LABEL_TO_ID = {"negative": 0, "neutral": 1, "positive": 2}

# BIO tag ids: 0=O, 1=B-PER, 2=I-PER, 3=B-ORG, 4=I-ORG, 5=B-LOC, 6=I-LOC, 7=B-MISC, 8=I-MISC.
NER_TAG_NAMES = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]
ENTITY_TYPES = ["PER", "ORG", "LOC", "MISC"]

# API prices, USD per 1M tokens.
LLM_API_COSTS = {
    "gpt-4o": {"input": 5.00, "output": 15.00, "blended": 10.00},
    "claude-haiku-4-5": {"input": 1.00, "output": 5.00, "blended": 3.00},
    "gemini-2.5-flash": {"input": 0.30, "output": 2.50, "blended": 1.40},
}

# Privacy level per deployment type; anything else is "unknown".
PRIVACY_RISK = {"api": "high", "on_premise": "low", "private_cloud": "medium"}
PRIVACY_DEFAULT = "unknown"

# GPU price (USD/hour) and the API every ROI is computed against.
GPU_COST_PER_HOUR = 2.50
ROI_REFERENCE_API = "gpt-4o"

# Generated-token budget per task (max_new_tokens), used for throughput.
TOKEN_BUDGETS = {
    "classification": 32,
    "financial_sentiment": 32,
    "ner": 64,
    "summarization": 128,
    "code_generation": 256,
}

# Stop markers for generated code; the solution is cut at the earliest one.
STOP_SEQUENCES = ["\nclass", "\ndef", "\n#", "\nif __name__", "\nprint("]

# Model outputs that mean "the call failed"; they count as wrong answers.
ERROR_SENTINELS = ["error", "Error", "Unknown", "unknown", "{}", ""]

# Declared benchmark grid.
MODELS = [
    "gpt-4o",
    "claude-haiku-4-5",
    "gemini-2.5-flash",
    "phi-4-mini-instruct",
    "Mistral-7B-v0.3",
    "Llama-3.2-3B-Instruct",
]
TASKS = ["classification", "ner", "summarization", "financial_sentiment", "code_generation"]

# Run-log conventions.
PHASE_FINE_TUNING = "phase2_fine_tuning"
BENCHMARK_PHASES = ["phase2_benchmark", "phase1_baseline"]

# Wide API-baseline runs: experiment -> (task, accuracy metric key); metric prefix -> model.
PHASE1_EXPERIMENT_TASKS = {
    "ag_news_baseline": ("classification", "accuracy"),
    "conll2003_baseline": ("ner", "f1"),
    "cnn_dailymail_baseline": ("summarization", "avg_rougeL"),
    "financial_sentiment_baseline": ("financial_sentiment", "accuracy"),
    "humaneval_baseline": ("code_generation", "pass_at_1"),
}
PHASE1_MODEL_PREFIXES = {"openai": "gpt-4o", "anthropic": "claude-haiku-4-5", "gemini": "gemini-2.5-flash"}

# Latency outlier threshold (seconds) and the pass@k ks reported.
LATENCY_OUTLIER_S = 10.0
PASS_AT_K = [1, 10]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------
