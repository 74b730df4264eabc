"""Secrets in configuration syntax, and qualified keys."""

import time

from reelquery.llm import secrets
from tests.llm.test_text_scans import literals


def test_bare_values_are_carried_to_references():
    for ref in ("$MATERIAL", "${MATERIAL}", '"$MATERIAL"', '"${MATERIAL}"'):
        assert literals(f"MATERIAL=Zx9qLm27Kd81\nDB_PASSWORD={ref}\n") == ["Zx9qLm27Kd81"]
    assert literals("#!/bin/sh\nexport MATERIAL=Zx9qLm27Kd81\nNEXT=$MATERIAL\nexport DB_PASSWORD=${NEXT}") == ["Zx9qLm27Kd81"]
    assert literals("  material: Zx9qLm27Kd81\n  password: ${material}\n") == ["Zx9qLm27Kd81"]
    assert literals("MATERIAL='Zx9qLm27Kd81'\nDB_PASSWORD=$MATERIAL") == ["Zx9qLm27Kd81"]


def test_prose_is_not_carried():
    long = "w " * 200
    for clean in ("DB_PASSWORD=${MATERIAL}", "he said MATERIAL=Zx9qLm27Kd81\nDB_PASSWORD=${MATERIAL}", long + "MATERIAL=Zx9qLm27Kd81\nDB_PASSWORD=${MATERIAL}", "MATERIAL=Zx9qLm27Kd81\nDB_PASSWORD='${MATERIAL}'"):
        assert literals(clean) == []


def test_qualified_keys():
    for name in ("encryption_key", "signing_key", "signingKey", "app.master-key"):
        assert literals(f'{name} = "q9W8e7R6t5Y4"') == ["q9W8e7R6t5Y4"]
    for name in ("key", "primary_key", "cache_key", "public_key"):
        assert literals(f'{name} = "q9W8e7R6t5Y4"') == []


def test_expressions_are_no_literals():
    for clean in (
        'password = os.environ["DB_PASSWORD"]', "password = getpass('Password: ')", "password = settings.DB_PASSWORD", "token: req.token", "const password = decrypt(cipher)",
        "api_key = keys[0]", "passphrase = ask_for_it()", "password = self.password", 'MATERIAL = "Zx9qLm27Kd81"\npassword = MATERIAL(1)',
    ):
        assert literals(clean) == [], clean
    assert literals("password: Zx9.qLm27Kd81") == ["Zx9.qLm27Kd81"]
    assert literals("token = eyJhbGciOi.eyJzdWIiOiIx.Zx9qLm27Kd81") == ["eyJhbGciOi.eyJzdWIiOiIx.Zx9qLm27Kd81"]
    assert literals("password: Zx9qLm27Kd81 (old)") == ["Zx9qLm27Kd81"]


def test_alternatives_of_expressions():
    a, b = "Zx9qLm27Kd81", "q9W8e7R6t5Y4"
    assert literals(f'password = prod ? "{a}" : "{b}";') == [a, b]
    assert literals(f'const password = env == "prod" ? "{a}" : "short"') == [a]
    assert literals(f"password = process.env.PASSWORD || '{a}'") == [a]
    assert literals(f'password: config.password ?? "{a}",') == [a]
    assert literals(f'password = os.environ.get("DB_PASSWORD", None) or "{a}"') == [a]
    assert literals(f'password = "{a}" if prod else "{b}"') == [a, b]
    assert literals(f'password = x; y = c ? "{a}" : "{b}"') == []
    assert a not in literals(f'secret: whether to take one or "{a}"')


def test_blocks_and_nested_values():
    a, b = "Zx9qLm27Kd81", "q9W8e7R6t5Y4"
    assert literals(f"db:\n  password: |\n    {a}\n    {b}\n  user: somebody\n") == [a, b]
    assert literals(f"password: >-\n  {a}\n\nother: |\n  {b}") == [a]
    assert literals(f"- token: |\n    {a}") == [a]
    assert literals(f"password: |\n{a}") == []
    assert literals('{"password": {"value": "%s"}}' % a) == [a]
    assert literals('{"password": {"type": "text", "value": "%s", "next": "%s"}}' % (a, b)) == [a]
    assert literals(f'db_password = {{\n  description = "none"\n  default = "{a}"\n}}') == [a]
    assert literals(f"password:\n  value: {a}\nvalue: {b}") == [a]
    assert literals(f"password:\nvalue: {a}") == []
    assert literals('{"color": {"value": "%s"}}' % a) == []


def test_elements():
    a = "Zx9qLm27Kd81"
    assert literals(f"<db>\n<password>{a}</password>\n</db>") == [a]
    assert literals(f'<server:password scheme="x">\n {a}\n</server:password>') == [a]
    assert literals(f'<add key="ApiKey" value="{a}"/>') == [a]
    for clean in (f"<password>{a}</user>", "<password>${db.password}</password>", "<password>two words</password>", f"<color>{a}</color>"):
        assert literals(clean) == []


def test_work_is_bounded():
    start = time.perf_counter()
    for text in ("password=(" * 40_000, "a=(" + "b" * 140 + ")", "<a>" * 130_000, "<a " * 130_000, "password:\n" * 40_000, "password: |\n  " * 30_000, 'password: {"a": ' * 25_000, "password = a ? " * 25_000, 'password="x"?' * 30_000):
        secrets.find(text if len(text) > 1000 else text * 2_500)
    assert time.perf_counter() - start < 90
