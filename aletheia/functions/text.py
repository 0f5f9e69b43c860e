"""Text functions: source names, labels, prompts and responses (F1-F8).

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen and work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Words that mark a split-suffixed source name ("x_train" -> "x").
SPLIT_WORDS = ("train", "dev", "test")
# Text appended to a question to make the generation prompt.
GENERATION_SUFFIX = ". Provide a single concise answer and write nothing else.\nAnswer: **"
# Judge prompt; {answer} and {generation} are the stripped, lower-cased texts.
# Note the trailing space after "answer?" and after the first two bullet lines.
JUDGE_TEMPLATE = (
    "\n"
    "Ground Truth Answer: {answer}\n"
    "Generated Answer: {generation}\n"
    "\n"
    "Does the generated answer convey the same meaning as the ground truth answer? \n"
    "- Ignore prefixes, suffixes, formatting, and minor variations. \n"
    "- Consider only the core meaning, not the exact wording. \n"
    "- Respond strictly with 'True' or 'False'.\n"
)
# JSON path of the text in a chat-completion response.
RESPONSE_CONTENT_PATH = "$.choices[0].message.content"
# ---------------------------------------------------------------------------

# Unicode-aware whitespace at either end (Spark's trim removes spaces only).
_EDGE_WS = r"(?U)^\s+|\s+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: Column | str) -> Column:
    """remove leading and trailing whitespace (tabs, newlines included)."""
    return F.regexp_replace(_c(col), _EDGE_WS, "")


def canonical_source(col: Column | str) -> Column:
    """names containing train/dev/test keep the text before the first '_'.

    ``latest_x`` -> ``latest`` (substring match, as in the reference);
    names without '_' are unchanged; NULL stays NULL.
    """
    c = _c(col)
    has_split_word = F.lit(False)
    for w in SPLIT_WORDS:
        has_split_word = has_split_word | c.contains(w)
    return F.when(has_split_word, F.substring_index(c, "_", 1)).otherwise(c)


def label_binary(col: Column | str) -> Column:
    """1 when lower(label) == 'true' (no strip), else 0; NULL stays NULL."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise((F.lower(c) == "true").cast("int"))


def generation_prompt(question: Column | str) -> Column:
    """the prompt sent to the generator for one question (NULL -> NULL)."""
    return F.concat(_c(question), F.lit(GENERATION_SUFFIX))


def judge_prompt(answer: Column | str, generation: Column | str) -> Column:
    """judge prompt from stripped, lower-cased answer and generation.

    NULL generation or NULL answer -> NULL prompt (the row is not sent).
    """
    a = F.lower(strip_ws(answer))
    g = F.lower(strip_ws(generation))
    head, rest = JUDGE_TEMPLATE.split("{answer}")
    mid, tail = rest.split("{generation}")
    return F.concat(F.lit(head), a, F.lit(mid), g, F.lit(tail))


def echo_answer(decoded: Column | str, prompt: Column | str) -> Column:
    """text between the first and second literal occurrence of the prompt.

    NULL when the prompt does not occur (the reference raises there).
    """
    d, p = _c(decoded), _c(prompt)
    return F.when(F.position(p, d) > 0, F.split_part(d, p, F.lit(2)))


def json_content(response: Column | str) -> Column:
    """F8: ``choices[0].message.content`` of a chat response, stripped."""
    return strip_ws(F.get_json_object(_c(response), RESPONSE_CONTENT_PATH))
