"""Credential values with symbols, spaces and names in camel case get a guess span of the whole value;
code that only names a value gets none."""

import pytest

from tallywork.llm import secrets


@pytest.mark.parametrize("text, value", [
    ('password: "Xk9;Qw!z#1"', "Xk9;Qw!z#1"),
    ('clientSecret: "P@s$w0rd!x7Qz"', "P@s$w0rd!x7Qz"),
    ("password\t=\tXk9<Qw>z#1;", "Xk9<Qw>z#1"),
    ("'db_password' => 'a,B;9 <k> \"q\" zZ'", "a,B;9 <k> \"q\" zZ"),
    ("token=Zx8,kQ2;vLw9, then", "Zx8,kQ2;vLw9"),
    ('mypwd: "Zx8\\"kQ2vLw9"', 'Zx8\\"kQ2vLw9'),
    ("clientSecret is Zx8!kQ2#vLw9.", "Zx8!kQ2#vLw9"),
    ('password: "Zx8!kQ2#vLw9', "Zx8!kQ2#vLw9"),
])
def test_whole_value(text, value):
    ranks = secrets.read_words()
    assert [text[s[1]:s[2]] for s in secrets.spans_of(text.encode(), ranks) if s[0] == "guess"] == [value]


@pytest.mark.parametrize("text", ['password: "" and "Zx8!kQ2#vLw9"', "The compass is Zx8!kQ2#vLw9", "password: 'changeme1'"])
def test_no_value(text):
    assert not [s for s in secrets.spans_of(text.encode(), secrets.read_words()) if s[0] == "guess"]


@pytest.mark.parametrize("text", [
    'password = os.environ["DB_PASSWORD"]', "secret = config.get_secret(name)", "secret = config.get_secret(name, 3)",
    "token: ${GITHUB_TOKEN}", 'token: "${GITHUB_TOKEN}"', "token={{ vault.token }}", 'api_key: "{{vault.token}}"',
    "password: <your-password-here>", "password=getpass()", "passwd = input('New-Password').strip();",
    "secret: https://example.com/help/reset-passwords", "token := env::var(\"DEPLOY_TOKEN_17\")", "pass = args['Password_17']",
    "password = %(DB_PASSWORD)s", "secret=$(cat_secret_file)",
])
def test_named_value(text):
    assert not [s for s in secrets.spans_of(text.encode(), secrets.read_words()) if s[0] == "guess"]


@pytest.mark.parametrize("text, value", [
    ("secret: https://user:Zx8kQ2vLw9@example.com/", "https://user:Zx8kQ2vLw9@example.com/"),
    ("password: Zx8(kQ2)vLw9", "Zx8(kQ2)vLw9"), ("password: {Zx8kQ2vLw9}", "{Zx8kQ2vLw9}"),
    ("(password: Zx8kQ2vLw9)", "Zx8kQ2vLw9"), ("password: $Zx8kQ2vLw9", "$Zx8kQ2vLw9"),
])
def test_real_value(text, value):
    assert [text[s[1]:s[2]] for s in secrets.spans_of(text.encode(), secrets.read_words()) if s[0] == "guess"] == [value]
