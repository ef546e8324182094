"""License notices across line ends, and long texts that only scatter a notice's words."""

from __future__ import annotations

import textwrap

from docspark.llm import license_scan
from tests.llm.conftest import prose


def best(text: str, template: str) -> float | None:
    """The largest containment of the template in any run of its length and the margin, if one meets it."""
    tokens, members = license_scan.template_sequence(text), set(license_scan.template_words(template))
    span = len(license_scan.template_sequence(template)) + license_scan.MARGIN
    most = max((len(members & set(tokens[i : i + span])) for i in range(len(tokens))), default=0)
    return most / len(members) if most >= license_scan.math.ceil(license_scan.THRESHOLD * len(members) - 1e-9) else None


def texts() -> list[str]:
    out = []
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        out += [prose(k, 30) + "\n" + textwrap.fill(t, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False) + "\n" + prose(k + 50, 30) for width, mark in ((76, ""), (30, " * "), (12, "# "))]
        out += [" ".join(x + " " + " ".join(prose(k + i, 40).split()) for i, x in enumerate(w)), " ".join(w[: len(w) // 2]) + " " + " ".join(prose(k, 9).split()) + " " + " ".join(w[len(w) // 2 :])]
        out += ["\n".join(w[: len(w) // 2]) + "\n" + prose(k, 12) + "\n".join(w[len(w) // 2 :]), " ".join(w[1:]), " ".join(reversed(w)) + " " + t]
    return out + [" ".join(t for _, t in license_scan.TEMPLATES), "\n", ""]


def test_notices_across_lines(spark):
    rows = list(enumerate(texts()))
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    labels = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in got}
    shares = {r["doc_id"]: {(m["label"], round(m["share"], 9)) for m in r["matches"]} for r in got}
    for d, t in rows:
        met = {(label, best(t, template)) for label, template in license_scan.TEMPLATES}
        met = {(label, round(x, 9)) for label, x in met if x is not None}
        base = set(next(r for r in got if r["doc_id"] == d)["base_labels"].split(",")) - {""}
        assert labels[d] == base | {x for x, _ in met}, (d, t)
        assert max((x for _, x in shares[d]), default=0) == max((x for _, x in met), default=0), (d, t)
    for k, (label, _) in enumerate(license_scan.TEMPLATES):
        assert all(label in labels[8 * k + i] for i in range(3)), label
    assert not shares[3] and {"bsd", "mpl", "cc0"} <= labels[len(rows) - 3]
