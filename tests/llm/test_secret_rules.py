"""Every rule finds a made-up value of its format, as plain Python does, and nothing in texts just short of it."""

from __future__ import annotations

import re

from dosescreen.llm import secret_scan

MIXED, HEXA = "aB1-cD2_eF3" * 20, "0123456789abcdef" * 10
PLAIN = "aB1cD2eF3" * 20
SAMPLES = {
    "assign": "token=abcdefgh1", "access": "AKIA" + "A1" * 8, "hex": HEXA[:33], "pem": "-----BEGIN EC PRIVATE KEY-----",
    "forge": "ghp_" + PLAIN[:36], "chat": "xoxb-" + PLAIN[:20], "xapp": "xapp-1-" + PLAIN[:20],
    "github_pat": "github_pat_" + PLAIN[:60], "glpat": "glpat-" + MIXED[:20], "glsa": "glsa_" + PLAIN[:32] + "_" + HEXA[:8],
    "AIza": "AIza" + MIXED[:35], "ya29": "ya29." + MIXED[:30], "GOCSPX": "GOCSPX-" + MIXED[:28],
    "live_key": "rk_test_" + PLAIN[:24], "whsec": "whsec_" + PLAIN[:32], "SK": "SK" + HEXA[:32],
    "SG": f"SG.{MIXED[:22]}.{MIXED[:43]}", "key": "key-" + HEXA[:32], "region_key": HEXA[:32] + "-us12",
    "npm": "npm_" + PLAIN[:36], "pypi": "pypi-AgEI" + MIXED[:50], "rubygems": "rubygems_" + HEXA[:48],
    "shop": "shpss_" + HEXA[:32], "sq0": "sq0csp-" + MIXED[:22], "v1": "dor_v1_" + HEXA[:64], "dapi": "dapi" + HEXA[:32],
    "hf": "hf_" + "aBcD" * 8 + "xy", "bot": "123456789:AA" + MIXED[:33], "hooks": "/api/webhooks/12345/" + MIXED[:60],
    "jwt": f"eyJ{PLAIN[:20]}.eyJ{PLAIN[:20]}.{MIXED[:20]}", "age": "AGE-SECRET-KEY-1" + "0A" * 29, "hvs": "hvs." + MIXED[:24],
    "atlas": ".atlasv1." + MIXED[:60], "NRAK": "NRAK-" + "A1B" * 9, "PMAK": f"PMAK-{HEXA[:24]}-{HEXA[:34]}",
    "lin_api": "lin_api_" + PLAIN[:40], "dp": "dp.pt." + PLAIN[:40], "account": "AccountKey=" + PLAIN[:88],
    "userinfo": "ftp://user:abcdefgh@",
}


def plain(text):
    """kind:start:end by start, then kind as listed."""
    spans = [(m.start(), k, m.end()) for k, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, text)
             if len(m.group(r.group)) >= r.least]
    return ",".join(f"{secret_scan.RULES[k].kind}:{s}:{e}" for s, k, e in sorted(spans))


def test_every_rule(docs):
    assert SAMPLES.keys() == {r.kind for r in secret_scan.RULES}
    texts = [f"漢字 é {x} and so on {x}" for x in SAMPLES.values()]
    texts += [f"just short: {x[:-1 - len(x) // 3]} end" for x in SAMPLES.values()] + [x[1:] for x in SAMPLES.values()]
    texts += [" ".join(SAMPLES.values()), "x" * 100000 + SAMPLES["jwt"], "=" * 5000]
    found = secret_scan.find(docs(list(enumerate(texts))))
    spans = {r["doc_id"]: r["listed"] for r in found.select("doc_id", secret_scan.listed(found["spans"]).alias("listed")).collect()}
    assert spans == {i: plain(t) for i, t in enumerate(texts)}
    for i, kind in enumerate(SAMPLES):
        assert f"{kind}:" in spans[i], kind


def test_the_index_has_each_trigram_that_a_text_holds(docs):
    grams = secret_scan.vocabulary()
    texts = ["aaaa", "", None, "Token TOKEN toKEN-----", "".join(grams), " ".join(SAMPLES.values()), "apiapikey:aa"]
    found = secret_scan.index(docs(list(enumerate(texts))), grams).collect()
    assert sorted((r["id"], r["gram"]) for r in found) == sorted(
        (i, g) for i, t in enumerate(texts) for g in grams if g in (t or "").lower())
