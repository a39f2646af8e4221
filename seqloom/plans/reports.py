"""Reports from small aggregates: JSON, text, MultiQC.

Keys and values of the JSON are fixed by the format that users of such reports read.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame

from seqloom.construct import Construct
from seqloom.operators import criteria, metrics

NEAR = ("1mm", "2mm", "3mm", "4mm+")


def _pct(part: int, total: int) -> float:
    return part / total * 100.0 if total else 0.0


def report(annotated: DataFrame, construct: Construct, weight: str | None = None, top: int = 20) -> dict:
    """All statistics as plain values, from three aggregations of bounded size; annotated should be persisted."""
    rows = metrics.outcomes(annotated, construct, weight).collect()
    total, valid = sum(r.n for r in rows), sum(r.n for r in rows if r.matched)
    n_const = len(construct.consts)
    whole = (1 << n_const) - 1
    count = lambda test: sum(r.n for r in rows if test(r))
    consts = []
    for k, c in enumerate(construct.consts):
        found = count(lambda r, k=k: r.mask >> k & 1)
        near = Counter({b: count(lambda r, k=k, b=b: r.const == k and r.bucket == b) for b in range(4)})
        consts.append(
            {
                "sequence": c, "found": found, "found_pct": _pct(found, total), "not_found": count(lambda r, k=k: r.const == k),
                "near_miss": {name: near[b] for b, name in enumerate(NEAR)},
            }
        )
    lengths: dict[int, dict[int, int]] = {}
    for r in metrics.rand_length_dist(annotated, weight).collect():
        lengths.setdefault(r.rand_idx, {})[r.length] = r.n
    rands = []
    for k, (_, r) in enumerate(construct.rands):
        bit = n_const + k
        inside = count(lambda x, bit=bit: x.mask >> bit & 1)
        outside = count(lambda x, bit=bit: x.mask & whole == whole and not x.mask >> bit & 1)
        rands.append(
            {
                "expected_range": f"{r.min_len}-{r.max_len}", "in_range": inside, "in_range_pct": _pct(inside, total), "out_of_range": outside,
                "length_distribution": {str(n): m for n, m in sorted(lengths.get(k, {}).items())},
            }
        )
    bases: list[list[dict]] = [[] for _ in construct.rands]
    for r in sorted(metrics.composition(annotated, construct, weight).collect(), key=lambda r: (r.rand_idx, r.position)):
        values = {"A": r.A, "T": r["T"], "G": r.G, "C": r.C}
        seen = sum(values.values())
        bases[r.rand_idx].append({"position": r.position, **values, **{f"{b}_pct": _pct(n, seen) for b, n in values.items()}})
    masks = Counter()
    for r in rows:
        masks[r.mask] += r.n
    names, combinations = construct.bit_names(), []
    for mask, n in sorted(masks.items(), key=lambda x: (-x[1], x[0]))[:top]:
        label = "ALL PASS" if mask == construct.all_pass else f"mask=0b{mask:b}"
        passed = [x for i, x in enumerate(names) if mask >> i & 1]
        combinations.append({"pass": passed, "fail": [x for x in names if x not in passed], "count": n, "pct": _pct(n, total), "mask": mask, "label": label})
    return {
        "summary": {"total_reads": total, "valid": valid, "valid_pct": _pct(valid, total), "invalid": total - valid},
        "per_const_segment": consts, "per_rand_segment": rands, "composition": bases, "combinations": combinations,
    }


def as_json(data: dict) -> str:
    return json.dumps(data, indent=2)


def summary_line(data: dict) -> str:
    s = data["summary"]
    return f"{s['valid']}/{s['total_reads']} ({s['valid_pct']:.2f}%) valid"


def as_text(data: dict, title: str = "Construct QC report") -> str:
    s = data["summary"]
    out = [title, "=" * 60, "", "Summary:", f"  Total reads: {s['total_reads']}", f"  Valid: {s['valid']} ({s['valid_pct']:.2f}%)"]
    out += [f"  Invalid: {s['invalid']} ({_pct(s['invalid'], s['total_reads']):.2f}%)", "", "Constant segments:"]
    for k, c in enumerate(data["per_const_segment"]):
        near = " ".join(f"{name}={c['near_miss'][name]}" for name in NEAR[:3])
        out.append(f"  {k} {c['sequence']}: found {c['found']} ({c['found_pct']:.2f}%), not found {c['not_found']}, near-miss {near}")
    out += ["", "Random segments:"]
    for k, r in enumerate(data["per_rand_segment"]):
        out.append(f"  {k} {r['expected_range']}: in range {r['in_range']} ({r['in_range_pct']:.2f}%), out of range {r['out_of_range']}")
    out += ["", "Combinations (top 10):", *[f"  {c['label']}: {c['count']} ({c['pct']:.2f}%)" for c in data["combinations"][:10]]]
    return "\n".join(out) + "\n"


def as_multiqc(data: dict, sample: str, mode: str = "and") -> str:
    """Custom content of the general statistics table: counts, rates, the mode, how often constants and structure were found, and reasons of failure."""
    s = data["summary"]
    values = {
        "total_reads": s["total_reads"], "valid_reads": s["valid"], "filtered_reads": s["invalid"], "pass_rate": s["valid_pct"],
        "filter_rate": _pct(s["invalid"], s["total_reads"]), "validation_mode": mode.upper(),
    }
    for k, c in enumerate(data.get("per_const_segment", [])):
        values[f"const_{k}_rate"] = c["found_pct"]
    for k, r in enumerate(data.get("per_rand_segment", [])):
        values[f"rand_{k}_rate"] = r["in_range_pct"]
    for r in data.get("validation", []):
        values[f"{r['criterion']}_rate"] = r["pct"]
    for r in data.get("failures", []):
        values[f"failed_{r['reason']}"] = r["n"]
    return json.dumps({"id": "construct_qc", "section_name": "Construct QC", "plot_type": "generalstats", "data": {sample: values}}, indent=2)


def criteria_report(judged: DataFrame, c: criteria.Criteria) -> dict:
    """Statistics of validation by single criteria; judged should be persisted."""
    checks = [r.asDict() for r in criteria.validation_summary(judged).collect()]
    valid = next(r for r in checks if r["criterion"] == "valid")
    total = judged.count()
    pairs = criteria.structure_pairs(judged).collect()
    return {
        "config": {k: v for k, v in vars(c).items() if v is not None},
        "summary": {"total_reads": total, "valid": valid["n"], "valid_pct": valid["pct"], "invalid": total - valid["n"]},
        "validation": [r for r in checks if r["criterion"] != "valid"],
        "failures": sorted((r.asDict() for r in criteria.failure_reasons(judged).collect()), key=lambda r: -r["n"]),
        "structure_pairs": [r.asDict() for r in sorted(pairs, key=lambda r: (-r.n, r.upstream_length, r.downstream_length))],
    }


def criteria_text(data: dict, top: int = 20) -> str:
    s, config = data["summary"], data["config"]
    out = ["Library validation report", "=" * 70, "", "Configuration:", *[f"  {k.replace('_', ' ')}: {v}" for k, v in config.items()], "", "Summary:"]
    out += [f"  Total sequences: {s['total_reads']}", f"  Valid sequences: {s['valid']} ({s['valid_pct']:.2f}%)"]
    out += [f"  Invalid sequences: {s['invalid']} ({_pct(s['invalid'], s['total_reads']):.2f}%)", "", "Criteria met:"]
    flank = ("upstream", "downstream", "structure")
    out += [f"  {r['criterion']}: {r['n']} ({r['pct']:.2f}%{' of sequences with constant' if r['criterion'] in flank else ''})" for r in data["validation"]]
    out += ["", "Failure reasons:", *[f"  {r['reason']}: {r['n']} ({r['pct']:.2f}% of invalid sequences)" for r in data["failures"] if r["n"]]]
    out += ["", "Structure pairs:", *[f"  ({r['upstream_length']}, {r['downstream_length']}): {r['n']} sequences ({r['percentage']:.2f}%)" for r in data["structure_pairs"][:top]]]
    return "\n".join(out) + "\n"
