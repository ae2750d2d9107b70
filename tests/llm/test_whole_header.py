import pytest

from lodestone.llm import origin as O

CODE = "import logging\n\n\ndef f(a):\n    return a + 1\n\n\n" * 8
LICENCE = "".join(f"# line {i} of a long licence\n" for i in range(90))


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a/x.py", LICENCE + "# Code generated by tool v1. DO NOT EDIT.\n" + CODE, "generated"), ("a/x.js", "/*\n" + " * words\n" * 90 + " * @generated by tool\n */\nvar a = 1;\n", "generated"), ("a/x.py", "\n" * 80 + "# @generated by tool\n" + CODE, "generated"),
        ("a/x.py", '"""Code generated by tool v1. DO NOT EDIT."""\n' + CODE, "generated"), ("a/x.py", "# licence\nr'''\nClient.\n\nGenerated by tool.\n@generated\n'''\n" + CODE, "generated"), ("a/x.py", '"""Says what it does."""\n\nx = """\n@generated by tool\n"""\n' + CODE, ""),
        ("a/x.py", LICENCE + CODE + "# Code generated by tool v1. DO NOT EDIT.\n", ""), ("a/x.py", LICENCE + "# Not generated: edit freely.\n" + CODE, ""),
    ],
)
def test_whole_header(path, text, kind):
    assert O.judge(path, text) == kind
