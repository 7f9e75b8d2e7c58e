import time

import pytest

from hotgrid.llm.secrets_scan import SENSITIVE, THRESHOLD, redact, scan, scan_secrets


def lexed(text):
    return [text[a:b] for a, b, kind in scan(text) if kind == "lexed"]


def test_every_name_can_decide():
    assert min(SENSITIVE.values()) >= THRESHOLD


@pytest.mark.parametrize("value", ["Tr0ub4dor&3(x)Zq9", "pä55wörtÜber99!", "a{7}Kq[2]zRt9", "x;9,Lm|4'Qw\u00e9Z"])
def test_quoted_values_may_have_any_characters(value):
    text = f'db.pwd = "{value}"'
    assert lexed(text) == [value]
    assert redact(text) == 'db.pwd = "[SECRET]"'


@pytest.mark.parametrize(
    "text",
    ['pwd = "${DB_PWD_1}x9Qz"', 'pwd: "{{ vault.pwd_2Ab }}"', 'pwd = "<your-Pwd-123>"', 'pwd = "[insert-Pwd-123]"', 'pwd = "%(pwd_1Ab)s"', "pwd: größer1AbcZ9x", "pwd = readSecret1(Abc9)", 'pwd = "Must have 8 letters"', 'key = "Xy12Zw34Ab56Cd78"'],
)
def test_templates_prose_and_plain_keys_are_clean(text):
    assert lexed(text) == []


def test_private_keys():
    body = "\n".join(["MIIEpAIBAAKCAQEA7bq9" * 3] * 3) + "=="
    for label in ("RSA PRIVATE KEY", "PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"):
        text = f"Here:\n-----BEGIN {label}-----\n{body}\n-----END {label}-----\nend"
        assert redact(text) == f"Here:\n-----BEGIN {label}-----\n[SECRET]\n-----END {label}-----\nend"
    assert lexed(f"-----BEGIN PRIVATE KEY-----\n{body}") == [body]  # cut off
    headed = f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n{body}"
    assert headed in lexed(f"-----BEGIN RSA PRIVATE KEY-----\n{headed}\n-----END RSA PRIVATE KEY-----")
    assert lexed(f"-----BEGIN PUBLIC KEY-----\n{body}\n-----END PUBLIC KEY-----") == []
    assert lexed("-----BEGIN PRIVATE KEY-----\n...\n-----END PRIVATE KEY-----") == []


def test_many_beginnings_take_linear_time():
    began = time.time()
    scan("-----BEGIN PRIVATE KEY-----\n" * 40_000 + "-" * 200_000)
    assert time.time() - began < 5


def test_empty_table_and_repeated_rows(spark):
    text = 'pwd = "Tr0ub4dor&3(x)Zq9"'
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, None, "c"), (3, "", "d")], "doc_id long, text string, spans string")
    rows = sorted((r.doc_id, r.spans) for r in scan_secrets(df).collect())
    assert rows == [(1, "lexed:7:24"), (1, "lexed:7:24"), (2, ""), (3, "")]
    empty = scan_secrets(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
