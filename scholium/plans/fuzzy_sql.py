"""SQL of the token sort ratio, for queries that compare names."""

from __future__ import annotations

_SORTED = "array_to_string(list_sort(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')), ' ') AS {0}"


def scored(pairs: str, columns: str) -> str:
    """Tables up to ``scored``: ``columns`` and the ``score`` of the strings a and b of each row of ``pairs``.

    The longest common subsequence is counted column by column over bit sets of the first string's places.
    """
    places = "list_sum(list_transform(range(0, len(ca)), lambda i: CASE WHEN ca[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT"
    steps = f"list_prepend(whole, list_transform(string_split(b, ''), lambda c: {places}))"
    left = f"list_reduce({steps}, lambda r, k: ((r + (r & k)) | (r - (r & k))) & whole)"
    return f"""_s AS (SELECT {columns}, {_SORTED.format("a")}, {_SORTED.format("b")} FROM {pairs}),
_m AS (SELECT *, string_split(a, '') AS ca, (1::HUGEINT << length(a)::INT) - 1 AS whole FROM _s),
scored AS (SELECT {columns}, 200::DOUBLE * (length(a) - bit_count({left})) / (length(a) + length(b)) AS score FROM _m)"""
