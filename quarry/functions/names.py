"""Scalar functions on paths, languages, kinds and marks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
LANGUAGES = {
    "rust": ["rs"],
    "python": ["py", "pyi"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "go": ["go"],
    "java": ["java"],
    "scala": ["scala", "sc"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"],
    "ruby": ["rb"],
    "shell": ["sh", "bash", "zsh", "fish"],
    "markdown": ["md", "mdx"],
    "json": ["json", "jsonc"],
    "yaml": ["yml", "yaml"],
    "toml": ["toml"],
    "html": ["html", "htm"],
    "css": ["css", "scss", "less"],
    "sql": ["sql"],
}
# Languages with symbols.
PARSED = ["rust", "python", "typescript", "javascript", "go", "java", "scala"]
# Names of symbol kinds and of file marks.
KINDS = {
    "function": "function", "fn": "function", "func": "function", "method": "method", "class": "class", "struct": "struct", "enum": "enum",
    "trait": "trait", "interface": "interface", "constant": "constant", "const": "constant", "variable": "variable", "var": "variable", "let": "variable",
    "type": "type", "module": "module", "mod": "module", "import": "import", "use": "import",
}
MARKS = {
    "documentation": "documentation", "doc": "documentation", "docs": "documentation", "ignore": "ignore", "test": "test", "tests": "test",
    "config": "config", "configuration": "config", "generated": "generated", "gen": "generated", "custom": "custom",
}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def components(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the last dot of the file name, lower case; '' for dot files and names without a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    return F.coalesce(lookup({e: lang for lang, own in LANGUAGES.items() for e in own}, extension(path)), F.lit("other"))


def has_symbols(language: Column) -> Column:
    return language.isin(PARSED)


def symbol_key(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def split_symbol_key(key: Column) -> tuple[Column, Column]:
    """Split at the last '::'."""
    return F.regexp_extract(key, r"^(.*)::([^:]*)$", 1), F.regexp_extract(key, r"^(.*)::([^:]*)$", 2)


def kind_named(name: str | None) -> str | None:
    """The kind that an alias stands for; an unknown one is an error."""
    if name is None:
        return None
    if name.lower() not in KINDS:
        raise ValueError(f"unknown kind: {name}")
    return KINDS[name.lower()]


def normalize_kind(kind: Column) -> Column:
    return lookup(KINDS, F.lower(kind))


def normalize_mark(mark: Column) -> Column:
    """Null: an unknown mark, to be rejected."""
    return lookup(MARKS, F.lower(mark))


def is_test_symbol(language: Column, name: Column, path: Column) -> Column:
    has = path.contains
    return (
        F.when(language == "rust", name.startswith("test") | has("/tests/"))
        .when(language == "python", name.startswith("test_") | has("test_") | has("_test."))
        .when(language.isin("typescript", "javascript"), has(".test.") | has(".spec.") | has("__tests__"))
        .when(language == "go", name.startswith("Test") | path.endswith("_test.go"))
        .when(language == "java", has("Test") | has("/test/"))
        .when(language == "scala", has("Spec") | has("Test") | has("/test/"))
        .otherwise(F.lit(False))
    )


# What a definition line of each language holds; {} is the name.
DEFINITION = {
    "rust": ["fn {}"],
    "python": ["def {}"],
    "typescript": ["function {}", "{} ="],
    "javascript": ["function {}", "{} ="],
    "go": ["func {}"],
    "java": ["class {}", "interface {}", "enum {}"],
    "scala": ["def {}", "object {}", "class {}", "trait {}"],
}
JAVA_WORDS = ["void ", "int ", "String ", "boolean ", "long ", "double ", "float ", "public ", "private ", "protected "]
TEXT_DEFINITION = ["fn {}", "def {}", "function {}", "func {}", "class {}", "interface {}", "object {}", "trait {}"]


def _holds(text: Column, phrases: list[str], name: Column) -> Column:
    found = F.lit(False)
    for p in phrases:
        before, after = p.split("{}")
        found = found | F.contains(text, F.concat(F.lit(before), name, F.lit(after)))
    return found


def is_definition_line(text: Column, name: Column, language: Column) -> Column:
    out = F.when(language == "sql", F.contains(F.lower(text), F.lit("create")) & F.contains(F.lower(text), F.lower(name)))
    for lang, phrases in DEFINITION.items():
        own = _holds(text, phrases, name)
        if lang == "java":
            words = F.lit(False)
            for w in JAVA_WORDS:
                words = words | text.contains(w)
            own = own | (F.contains(text, name) & words)
        out = out.when(language == lang, own)
    return out.otherwise(F.lit(False))


def is_text_definition_line(text: Column, name: Column) -> Column:
    return _holds(text, TEXT_DEFINITION, name)
