"""Deterministic stand-ins for a generator and a judge (tests of the plumbing only)."""

import hashlib
import sys

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests' folder

# Fixed vocabulary of the stand-in generator.
STANDIN_WORDS = ("paris", "blue", "seven", "water", "true", "unknown", "1969", "einstein")


def standin_generator():
    """Answer word and an 8 × 8 activation list from sha256(prompt|gen_idx)."""

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        decoded, acts = [], []
        for prompt, g in zip(batch["prompt"], batch["gen_idx"]):
            if prompt is None:
                raise ValueError("NULL prompt")
            h = hashlib.sha256(f"{prompt}|{g}".encode()).hexdigest()
            decoded.append(prompt + STANDIN_WORDS[int(h[:8], 16) % len(STANDIN_WORDS)])
            vals = [(int(c, 16) - 7.5) / 7.5 for c in h]
            acts.append([vals[i * 8 : i * 8 + 8] for i in range(8)])
        return pd.DataFrame({"decoded": decoded, "hidden_states": acts})

    return fn


def standin_labeller():
    """'True' when the generated answer equals the ground truth in the judge
    prompt, else 'False'; fails (→ NULL) when the generated answer is 'error'."""

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in batch["prompt"]:
            truth = p.split("Ground Truth Answer: ", 1)[1].split("\nGenerated Answer: ", 1)
            answer, rest = truth[0], truth[1]
            generated = rest.split("\n\nDoes the generated answer", 1)[0]
            if generated == "error":
                raise RuntimeError("judge call failed")
            out.append("True" if generated == answer else "False")
        return pd.DataFrame({"response": out})

    return fn
