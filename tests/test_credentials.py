from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from tests.helpers import frame
from wardline.operators import credentials

K1, K2 = hashlib.sha256(b"one").digest(), hashlib.sha256(b"two").digest()
at = lambda: F.lit("2024-01-16").cast("timestamp")
FUTURE, PASSED = 1_800_000_000, 1_000_000_000


def token(claims, key=K1, body=None):
    body = body if body is not None else base64.b64encode(json.dumps(claims).encode()).decode()
    return body + "." + hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


GOOD = {"sub": "bo-kira", "grant_id": "g-trade", "exp": FUTURE}
CASES = {
    "good": (token(GOOD), None),
    "good_named_key": (token({**GOOD, "kid": "k2"}, K2), None),
    "fraction": (token({**GOOD, "exp": FUTURE + 0.5}), None),
    "absent": (None, "absent"),
    "empty": ("", "absent"),
    "unsigned": (token(GOOD).split(".")[0], "not_two_parts"),
    "three_parts": (token(GOOD) + ".x", "not_two_parts"),
    "bad_base64": (token(None, body="!!!"), "bad_base64"),
    "bad_utf8": (token(None, body=base64.b64encode(b"\xff\x00").decode()), "bad_base64"),
    "bad_json": (token(None, body=base64.b64encode(b"not json").decode()), "bad_json"),
    "unknown_key": (token({**GOOD, "kid": "k9"}), "unknown_key"),
    "wrong_key": (token(GOOD, b"attacker"), "bad_signature"),
    "key_swap": (token({**GOOD, "kid": "k2"}, K1), "bad_signature"),
    "changed_claims": (base64.b64encode(b'{"sub":"x","exp":1800000000}').decode() + "." + token(GOOD).split(".")[1], "bad_signature"),
    "no_exp": (token({"sub": "a"}), "no_expiry"),
    "exp_text": (token({**GOOD, "exp": "soon"}), "no_expiry"),
    "expired": (token({**GOOD, "exp": PASSED}), "expired"),
    "expires_now": (token({**GOOD, "exp": 1705363200}), "expired"),  # expiry at this very instant
    "extended": (base64.b64encode(json.dumps({**GOOD, "exp": FUTURE}).encode()).decode() + "." + token({**GOOD, "exp": PASSED}).split(".")[1], "bad_signature"),
}


def test_every_stage(spark, keys):
    df = frame(spark, [(n, t) for n, (t, _) in CASES.items()], "name string, token string")
    seen = credentials.inspect_tokens(df, keys, at()).collect()
    assert {r.name: r.stage for r in seen} == {n: s for n, (_, s) in CASES.items()}
    assert {r.name for r in seen if r.claims is not None} == {n for n, (_, s) in CASES.items() if s is None}


def test_bad_tokens_give_null_claims(spark, keys):
    df = frame(spark, [(n, t) for n, (t, _) in CASES.items()], "name string, token string")
    for r in credentials.verify_tokens(df, keys, at()).collect():
        good = CASES[r.name][1] is None
        assert r.verified == good and (r.sub, r.grant_id) == (("bo-kira", "g-trade") if good else (None, None))


def test_signing_round_trip_matches_python(spark, keys):
    claims = frame(spark, [("bo-kira", "g-trade", str(FUTURE), None), ("ünï", None, str(FUTURE), "k2")],
                   "sub string, grant_id string, exp string, kid string")
    out = credentials.sign_claims(claims, keys, ["sub", "grant_id", "exp", "kid"]).collect()
    for r in out:
        body, mac = r.token.split(".")
        assert json.loads(base64.b64decode(body)) == {"sub": r.sub, "grant_id": r.grant_id, "exp": r.exp, "kid": r.kid}
        assert mac == hmac.new(K2 if r.kid else K1, body.encode(), hashlib.sha256).hexdigest()


def test_long_keys_are_hashed_first(spark):
    from wardline.functions.crypto import hmac_hex, key_pads

    secret = b"x" * 100
    pads = key_pads(frame(spark, [("k", secret.hex())], "kid string, secret_hex string"))
    got = pads.select(hmac_hex(F.lit("msg"), "ipad", "opad").alias("m")).first().m
    assert got == hmac.new(secret, b"msg", hashlib.sha256).hexdigest()


def test_viewers(spark, world, keys):
    rows = [("al-ines", "alpina"), ("bo-kira", "alpina"), ("bo-plan", "borealis"), ("cb-mina", "cobalt"), ("nobody", "cobalt")]
    tokens = frame(spark, [(token({"sub": s, "audit_org": o, "exp": FUTURE}),) for s, o in rows]
                   + [(token({"sub": "al-jonas", "audit_org": "alpina", "exp": FUTURE}, b"forged"),)], "token string")
    got = credentials.viewer_orgs(tokens, keys, world["principal"], at()).select("sub", "viewer_org").collect()
    assert sorted(map(tuple, got)) == [("al-ines", "alpina"), ("cb-mina", "cobalt")]
