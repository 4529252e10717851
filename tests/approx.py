"""Approximate containment by plain dynamic programming, for comparison."""


def fuzzy_contains_reference(pattern: str, text: str) -> bool:
    """Plain dynamic-programming approximate substring match (for tests):
    min over substrings of the edit distance, compared with k."""
    k = -(-len(pattern) // 10)
    m = len(pattern)
    prev = list(range(m + 1))  # column for the empty text prefix
    best = prev[m]
    for ch in text:
        cur = [0] * (m + 1)  # a match may start anywhere: row 0 is free
        for i in range(1, m + 1):
            cur[i] = min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (pattern[i - 1] != ch))
        best = min(best, cur[m])
        prev = cur
    return best <= k
