import random
import re

from siltstone.operators.safety import RULES, inspect

SCHEMA = "id long, domain string, subject_kind string, include_contacts boolean, claims array<struct<kind:string,text:string>>, texts array<string>"
PIECES = ["the plan ", "导师", "Professor ", "不行", "垃圾", "色情", "推翻政府", "代做", "录取概率", "Offer 概率", "offer 概率", "往届", "去年", "2024年报名", "a@b.org", "13812345678", "1391a@b.co2345678", "2024 竞赛分析报告目录", "教育部白名单", "good ", "导师愿意接收"]


def plain(r):
    """One result by the rules, a term at a time."""
    _, domain, kind, may, claims, texts = r
    claims, texts = [(k, t or "") for k, t in claims or []], [t or "" for t in texts or []]
    every = [t for _, t in claims] + texts
    low = [t.lower() for t in every]
    for name, c in RULES.categories.items():
        for t in low:
            hit = any(x.lower() in t for x in c.terms)
            if c.subjects and c.attacks:
                hit = hit or ((kind == "mentor" or any(x.lower() in t for x in c.subjects)) and any(x.lower() in t for x in c.attacks))
            if hit:
                return "refused", name, [("content_policy_refusal", name), (name, None)], [], [RULES.refusal]
    together = "\n".join(texts)
    unsafe = next((t for t in every if any(p in t for p in RULES.unsafe)), None)
    fake = all(p in together for p in RULES.mislabel[:2])
    if unsafe is not None or fake:
        return "emptied", None, [("unsafe_advice", RULES.mislabel[2] if fake else unsafe)], claims, []
    likely = [p for p in RULES.probability if any(p in t for t in every)]
    old = [p for p in RULES.stale if domain == "competition" and any(p in t for t in every)]
    has = lambda t: any(re.search(p, t) for p in RULES.contacts)
    exposed = not may and any(map(has, every))

    def bare(t):
        for p in RULES.contacts:
            t = re.sub(p, "", t)
        return t

    kept = [("uncertain" if k == "fact" and any(p in t for p in old) else k, bare(t) if exposed else t) for k, t in claims if not any(p in t for p in likely)]
    out = []
    for t in texts:
        for p in likely:
            t = t.replace(p, "")
        for p in old:
            t = t.replace(p, p + RULES.mark)
        out.append(t if may else bare(t))
    left = exposed and any(map(has, out))
    warned = [("no_probability_claim", p) for p in likely] + [("stale_fact", p) for p in old] + [("unauthorized_contact", None)] * exposed
    return "emptied" if left else "passed", None, warned, kept, [] if left else out


def test_results_against_the_rules_one_by_one(spark):
    draw = random.Random(1)
    text = lambda: "".join(draw.choices(PIECES, [9, 1, 1, 1, 1, 0.3, 0.3, 0.6, 2, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1, 9, 1], k=draw.randrange(4)))
    rows = []
    for i in range(600):
        claims = [(draw.choice(["fact", "advice"]), text()) for _ in range(draw.randrange(3))]
        rows.append((i, draw.choice(["competition", "generic", None]), draw.choice(["mentor", None, "x"]), draw.choice([True, False, None]), claims, [text() for _ in range(draw.randrange(3))]))
    rows += [(1000, None, None, None, None, None), (1001, "competition", "", False, [("fact", None)], [None, ""]), (1002, "generic", None, False, [], ["long " * 50_000 + "色情"])]
    got = {r.id: (r.status, r.category, [tuple(w) for w in r.warnings], [tuple(c) for c in r.claims], r.texts) for r in inspect(spark.createDataFrame(rows, SCHEMA).repartition(4), "id").collect()}
    want = {r[0]: plain(r) for r in rows}
    assert got == want
    assert {w[0] for w in want.values()} == {"refused", "emptied", "passed"} and {w[1] for w in want.values()} >= {"mentor_attack", "political_sensitive", "sexual_content", "personal_attack"}
