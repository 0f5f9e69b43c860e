"""Column-level functions (JVM-side expressions, no Python UDFs)."""

from aletheia.functions.text import (  # noqa: F401
    GENERATION_SUFFIX,
    JUDGE_TEMPLATE,
    canonical_source,
    echo_answer,
    generation_prompt,
    judge_prompt,
    json_content,
    label_binary,
    strip_ws,
)
from aletheia.functions.vectors import (  # noqa: F401
    cosine,
    dot,
    l2_norm,
    pool,
    sigmoid,
    softmax2_class1,
)
