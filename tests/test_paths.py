"""Driver-side path grammar (no Spark needed)."""

from weft.functions.paths import Bad, Index, Name, Pred, base_path, parse_path, split_path
from weft.functions.patterns import date_format_pattern, date_parse_pattern, date_token_error, js_regex_to_java


def test_split_path_examples():
    assert split_path("identifier.use") == ["identifier", "use"]
    assert split_path("identifier[0].use") == ["identifier", "0", "use"]
    assert split_path("extension[?url='a.b'].valueString") == ["extension", "[?url='a.b']", "valueString"]
    assert split_path("meta.profile[0]") == ["meta", "profile", "0"]
    assert split_path("a..b") == ["a", "b"]
    assert split_path("") == []


def test_brackets_in_quotes_and_unbalanced_ones():
    assert split_path("a[?k='x].y'].b") == ["a", "[?k='x].y']", "b"]
    assert split_path("a[?u='http://h/p[0].q'][2].c") == ["a", "[?u='http://h/p[0].q']", "2", "c"]
    assert split_path("a[?k='v].b") == ["a", "[?k='v]", "b"]
    assert split_path("a[1.b") == ["a", "[1.b"]
    assert split_path("[3]x[4][5].") == ["3", "x", "4", "5"]
    assert split_path(None) == []
    assert parse_path("a[?k='x].y']") == [Name("a"), Pred("k", "x].y")]


def test_parse_path_kinds():
    assert parse_path("a[2].b") == [Name("a"), Index(2), Name("b")]
    assert parse_path("a[?k='v'].b") == [Name("a"), Pred("k", "v"), Name("b")]
    assert parse_path("a[?k=v]") == [Name("a"), Bad("[?k=v]")]
    assert parse_path("identifier:cpf.value") == [Name("identifier:cpf"), Name("value")]


def test_base_path():
    assert base_path("name[0].text") == "name"
    assert base_path("birthDate") == "birthDate"


def test_pattern_translation():
    assert date_parse_pattern("dd/MM/yyyy") == "d/M/y"
    assert js_regex_to_java("^\\d{11}$") == "^\\d{11}\\z"
    assert date_parse_pattern("yyyyMMdd") == "yyyyMMdd"
    assert date_format_pattern("do MMMM yyyy") == ["do", " MMMM yyyy"]
    assert date_token_error("DD/MM/YYYY", False) == "DD" and date_token_error("yyyy-MM-dd'T'HH:mm", True) is None
    assert js_regex_to_java("[$]a\\$") == "[$]a\\$"
    assert js_regex_to_java("^[[]a{x}b{2}$") == "^[\\[]a\\{x\\}b{2}\\z"
