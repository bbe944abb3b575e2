"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from . import alignment, exact_dedup, html_extract, license_scan, line_dedup, mixing, near_dedup, packing, secret_scan, spelling, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_topk": topk.op4_exact_topk,
        "op6_warc": warc.op6_warc,
        "op10_html": html_extract.op10_html,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_packing": packing.op8_packing,
        "op9_mixing": mixing.op9_mixing,
        "op11_spelling": spelling.op11_spelling,
        "op12_alignment": alignment.op12_alignment,
        "op13_secret_scan": secret_scan.op13_secret_scan,
    }


def oracle_sql() -> dict:
    return {"op1_exact_dedup": exact_dedup.SQL, "op4_exact_topk": topk.SQL, "op6_warc": warc.SQL, "op11_spelling": spelling.SQL, "op13_secret_scan": secret_scan.SQL}
