"""Helpers of the tests in this folder."""

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_by_id(frame, *columns):
    out = {}
    for row in frame.select("doc_id", *columns).collect():
        out.setdefault(row[0], []).append(row[1] if len(columns) == 1 else tuple(row[1:]))
    return {k: v[0] for k, v in out.items() if len(v) == 1} | {
        k: sorted(v, key=str) for k, v in out.items() if len(v) > 1}
