"""JSON inside free texts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def largest_json(text: str | None) -> str | None:
    """Longest stretch of a text that is a JSON object, in standard form; None if there is none."""
    text, decoder, at = text or "", json.JSONDecoder(), 0
    best: tuple[int, object] = (0, None)
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        best = max(best, (end - at, value), key=lambda x: x[0])
        at = end
    return json.dumps(best[1], sort_keys=True, ensure_ascii=False) if best[0] else None


def fields_between(text: str | None, names: list[str]) -> dict[str, str]:
    """Fields of a JSON object; of a broken one, what stands between one key and the next."""
    found = json.loads(largest_json(text) or "{}")
    if found.keys() & set(names):
        return {n: "" if n not in found else found[n] if isinstance(found[n], str) else json.dumps(found[n], ensure_ascii=False) for n in names}
    out = dict.fromkeys(names, "")
    pieces = re.split(r'"(' + "|".join(map(re.escape, names)) + r')"\s*:', text or "") if names else [""]
    for name, value in zip(pieces[1::2], pieces[2::2]):
        bare = value.strip().rstrip(",}").strip()
        out[name] = out[name] or bare.removeprefix('"').removesuffix('"').replace("\\n", "\n").replace('\\"', '"').strip()
    return out


@F.pandas_udf(T.StringType())
def largest_json_udf(text: pd.Series) -> pd.Series:
    return text.map(largest_json)
