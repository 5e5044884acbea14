import pytest
from hypothesis import given, settings, strategies as st

from quillguard.functions import validators
from quillguard.functions.kernel import Kernel, Scope, entity_kind, replace_entities
from quillguard.functions.patterns import detectors

BUILT = Kernel(detectors())


def run(text, kernel=BUILT):
    scope = Scope()
    return kernel.redact(text, scope), scope.counts


@pytest.mark.parametrize("text, kind", [
    ("key sk-ant-" + "a1B2" * 6, "APIKEY"), ("AKIA" + "ABCD1234" * 2, "APIKEY"), ("ghp_" + "a" * 36, "APIKEY"),
    ("eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "JWT"), ("ssn 123-45-6789", "SSN"), ("at 192.168.0.1", "IP"),
    ("4111 1111 1111 1111", "CARD"), ("a.b@example.com", "EMAIL"), ("+30 210 1234567", "PHONE"), ("GR16 0110 1250 0000 0001 2300 695", "IBAN"),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "PRIVATEKEY"), ("Authorization Bearer abcdefgh1", "SECRET"),
])
def test_each_kind(text, kind):
    out, counts = run(text)
    assert counts == {kind: 1} and f"[{kind}_1]" in out


@pytest.mark.parametrize("text", ["", "Version 1.2 in Q3 at 10:30.", "4111 1111 1111 1112", "+1 (743) 555-3824", "007.1.1.1000"])
def test_plain_text_stays(text):
    assert run(text) == (text, {})


def test_numbers_by_value_and_counts_by_occurrence():
    assert run("a@x.io b@x.io a@x.io") == ("[EMAIL_1] [EMAIL_2] [EMAIL_1]", {"EMAIL": 3})


def test_numbers_follow_stage_order():
    out, _ = run("AKIA" + "A" * 16 + " sk-" + "b" * 20)
    assert out == "[APIKEY_2] [APIKEY_1]"


def test_a_later_stage_sees_tokens():
    jwt = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    assert run("password=" + jwt) == ("password=[SECRET_1]", {"JWT": 1, "SECRET": 1})
    assert run("token: Bearer abcdefgh") == ("token: [SECRET_1] abcdefgh", {"SECRET": 1})


def test_boundaries_are_ascii_and_folding_is_unicode():
    assert run("é123-45-6789")[1] == {"SSN": 1}
    assert run("toKen=abcdef")[1] == {"SECRET": 1}
    assert run("paſsword=abcdef")[1] == {"SECRET": 1}
    assert run("password=\vabc")[0] == "password=[SECRET_1]"  # a vertical tab is no white space here


def test_eu_pack_and_checks():
    eu = Kernel(detectors(eu=True))
    assert run("01019000122", eu)[1] == {"AMKA": 1} and run("123456783", eu)[1] == {"TAXID": 1} and run("EL123456783", eu)[1] == {"VAT": 1}
    assert run("01019000123", eu)[1] == {} and run("99019000122", eu)[1] == {} and run("123456784", eu)[1] == {} and run("000000000", eu)[1] == {}
    assert not validators.afm("12") and not validators.amka("1")


def test_names_and_terms():
    k = Kernel(detectors(terms=["Blue Fox", "", "a+b"], names=True))
    assert run("the BLUE fox", k)[1] == {"NAME": 1} and run("xa+by", k)[1] == {}
    assert run("Dr. Élan saw Maria Papadopoulou", k)[1] == {"NAME": 1}
    assert run("Prof Smith at 12 Long Street", k)[1] == {"NAME": 1, "ADDRESS": 1}


def test_entities():
    scope = Scope()
    out = replace_entities("Maria P met Maria at [EMAIL_1]", [("PER", "Maria"), ("person", "Maria P"), ("X", "1"), ("X", "")], scope)
    assert out == "[NAME_1] met [NAME_2] at [EMAIL_1]" and entity_kind("gpe") == "ADDRESS" and entity_kind("x_y") == "X_Y"


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab1 -=:@.[]_\"'éK\n"), max_size=60))
def test_tokens_equal_counts(text):
    out, counts = run(text)
    assert all(n > 0 for n in counts.values()) and (counts or out == text)
