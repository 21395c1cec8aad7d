"""Fixed dimensions: languages, symbol kinds, features, file types, node types, servers, timeouts.

All are a few hundred literal rows at most, so joins with them broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values ---------------------------------------------------------------------

#: Symbol kinds; a kind's number is its place, from 1.
KINDS = (
    "file", "module", "namespace", "package", "class", "method", "property", "field", "constructor", "enum", "interface", "function", "variable",
    "constant", "string", "number", "boolean", "array", "object", "key", "null", "enum_member", "struct", "event", "operator", "type_parameter",
)
TYPE_KINDS = ("class", "interface", "struct", "enum", "type_parameter")
CALLABLE_KINDS = ("function", "method", "constructor")
LOW_LEVEL_KINDS = ("variable", "constant", "string", "number", "boolean", "array", "object", "key", "null")
#: Kinds that can be asked for by name, and other names for them.
NAMED_KINDS = ("file", "module", "namespace", "package", "class", "method", "property", "field", "constructor", "enum", "interface", "function", "variable", "constant", "struct", "enum_member", "type_parameter")
KIND_ALIASES = {"trait": "interface", "enummember": "enum_member", "typeparameter": "type_parameter"}

#: language id, shown name, extensions, other names, build folders
LANGUAGES = (
    ("rust", "Rust", "rs", "rust rs", "target"),
    ("cpp", "C++", "c cpp cc cxx h hpp hxx", "cpp c++ c", "build cmake-build-debug cmake-build-release out"),
    ("zig", "Zig", "zig", "zig", "zig-out zig-cache"),
    ("java", "Java", "java", "java", "target build bin out classes .gradle"),
    ("kotlin", "Kotlin", "kt kts", "kotlin kt", "build out .gradle .kotlin"),
    ("scala", "Scala", "scala sc", "scala", "target .bloop .metals .bsp"),
    ("clojure", "Clojure", "clj cljs cljc edn", "clojure clj", "target .cpcache .clj-kondo"),
    ("csharp", "C#", "cs", "csharp c# cs", "bin obj packages .vs"),
    ("fsharp", "F#", "fs fsx fsi", "fsharp f# fs", "bin obj packages .ionide .fake paket-files"),
    ("typescript", "TypeScript", "ts tsx mts cts", "typescript ts", "node_modules dist build coverage .next .nuxt"),
    ("javascript", "JavaScript", "js jsx mjs cjs", "javascript js", "node_modules dist build coverage .next .nuxt"),
    ("vue", "Vue", "vue", "vue", "node_modules dist build .nuxt"),
    ("python", "Python", "py pyi", "python py", "__pycache__ .venv venv .env build dist .eggs .mypy_cache .pytest_cache .pixi"),
    ("ruby", "Ruby", "rb rake gemspec", "ruby rb", "vendor .bundle tmp log coverage .yardoc pkg"),
    ("php", "PHP", "php", "php", "vendor node_modules cache"),
    ("perl", "Perl", "pl pm t", "perl pl", "blib _build local"),
    ("lua", "Lua", "lua", "lua", ".luarocks lua_modules"),
    ("shellscript", "Bash", "sh bash zsh", "bash sh shell", ""),
    ("powershell", "PowerShell", "ps1 psm1 psd1", "powershell pwsh ps1", ""),
    ("haskell", "Haskell", "hs lhs", "haskell hs", "dist dist-newstyle .stack-work .cabal-sandbox"),
    ("elixir", "Elixir", "ex exs", "elixir ex", "_build deps .elixir_ls"),
    ("erlang", "Erlang", "erl hrl", "erlang erl", "_build deps ebin"),
    ("elm", "Elm", "elm", "elm", "elm-stuff"),
    ("ocaml", "OCaml", "ml mli", "ocaml ml", "_build _opam"),
    ("go", "Go", "go", "go golang", "vendor"),
    ("swift", "Swift", "swift", "swift", ".build DerivedData .swiftpm"),
    ("dart", "Dart", "dart", "dart", ".dart_tool build .pub-cache"),
    ("terraform", "Terraform", "tf tfvars hcl", "terraform tf hcl", ".terraform"),
    ("yaml", "YAML", "yaml yml", "yaml yml", ""),
    ("toml", "TOML", "toml", "toml", ""),
    ("nix", "Nix", "nix", "nix", "result .direnv"),
    ("rego", "Rego", "rego", "rego", ""),
    ("r", "R", "r rmd", "r", "renv"),
    ("julia", "Julia", "jl", "julia jl", ".julia"),
    ("fortran", "Fortran", "f f90 f95 f03 f08 for", "fortran f90", ""),
    ("markdown", "Markdown", "md markdown", "markdown md", ""),
)

#: feature id, shown name, command
FEATURES = (
    ("find_symbol", "find symbol", "find symbol"),
    ("find_references", "find references", "find refs"),
    ("goto_definition", "go to definition", "find def"),
    ("goto_type_definition", "go to type definition", "find typedef"),
    ("find_implementations", "find implementations", "find impl"),
    ("hover", "hover", "hover"),
    ("diagnostics", "diagnostics", "diagnostics"),
    ("rename", "rename", "rename"),
    ("incoming_calls", "incoming calls", "calls incoming"),
    ("outgoing_calls", "outgoing calls", "calls outgoing"),
    ("code_actions", "code actions", "actions list"),
    ("type_hierarchy", "type hierarchy", "types"),
    ("inlay_hints", "inlay hints", "hints"),
)
#: A language's level for all features, and the features where it differs.
SUPPORT = {
    "rust": ("full", {}),
    "cpp": ("full", {"incoming_calls": "partial", "outgoing_calls": "none"}),
    "go": ("full", {}),
    "java": ("full", {}),
    "typescript": ("partial", {"find_symbol": "full", "goto_definition": "full", "type_hierarchy": "none"}),
    "javascript": ("partial", {"find_symbol": "full", "goto_definition": "full", "type_hierarchy": "none"}),
    "python": ("partial", {"find_implementations": "none", "incoming_calls": "none", "outgoing_calls": "none", "type_hierarchy": "none"}),
    "kotlin": ("full", {"find_symbol": "partial", "find_references": "partial", "goto_type_definition": "partial", "rename": "partial", "find_implementations": "none", "incoming_calls": "none", "outgoing_calls": "none", "type_hierarchy": "none", "inlay_hints": "none"}),
    "php": ("full", {"rename": "none", "find_implementations": "none", "incoming_calls": "none", "outgoing_calls": "none", "type_hierarchy": "none"}),
}
OTHER_SUPPORT = "partial"

#: Files that show a server the project, by language, in the order they are looked for.
MANIFESTS = {
    "typescript": ("tsconfig.json", "jsconfig.json", "package.json"),
    "javascript": ("tsconfig.json", "jsconfig.json", "package.json"),
    "python": ("pyproject.toml", "setup.py", "setup.cfg"),
    "rust": ("Cargo.toml",),
    "kotlin": ("build.gradle.kts", "build.gradle", "settings.gradle.kts"),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "go": ("go.mod",),
}

#: alias, type of text search
FILE_TYPES = {
    "rust": "rust", "rs": "rust", "typescript": "ts", "ts": "ts", "tsx": "ts", "javascript": "js", "js": "js", "jsx": "js", "python": "py", "py": "py",
    "go": "go", "golang": "go", "java": "java", "kotlin": "kotlin", "kt": "kotlin", "c": "c", "cpp": "cpp", "c++": "cpp", "csharp": "csharp", "cs": "csharp",
    "ruby": "ruby", "rb": "ruby", "php": "php", "lua": "lua", "bash": "sh", "sh": "sh", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "md", "markdown": "md", "html": "html", "css": "css", "sql": "sql", "swift": "swift", "scala": "scala", "elixir": "elixir", "haskell": "haskell", "hs": "haskell",
}

#: language: timeout factor, indexing wait ms, cross-file wait ms, aggressive retries
PROFILES = {
    "kotlin": (10.0, 15000, 2000, True),
    "python": (8.0, 30000, 1500, True),
    "java": (3.0, 10000, 1000, True),
    "typescript": (2.5, 15000, 1000, False),
    "javascript": (2.5, 15000, 1000, False),
    "rust": (1.5, 8000, 0, False),
    "go": (1.0, 5000, 0, False),
    "cpp": (1.5, 5000, 500, False),
    "csharp": (2.0, 8000, 500, False),
}
OTHER_PROFILE = (1.5, 3000, 0, False)

#: operation: timeout factor, methods; all other methods are requests
OPERATIONS = {
    "request": (1.0, ()),
    "workspace": (6.0, ("workspace/symbol", "textDocument/references", "textDocument/implementation", "textDocument/prepareCallHierarchy", "callHierarchy/incomingCalls", "callHierarchy/outgoingCalls")),
    "rename": (10.0, ("textDocument/rename", "textDocument/prepareRename")),
    "initialization": (2.0, ("initialize",)),
    "shutdown": (0.5, ("shutdown",)),
}

#: tier: seconds for init, request, cross-file request, shutdown
TIERS = {"fast": (15, 15, 20, 5), "standard": (45, 30, 45, 5), "slow": (120, 60, 90, 5)}
#: language: server, command, arguments, argument for the version, how to install it, tier
SERVERS = {
    "rust": ("rust-analyzer", "rust-analyzer", (), "--version", "rustup component add rust-analyzer", "fast"),
    "cpp": ("clangd", "clangd", ("--background-index", "--header-insertion=iwyu", "--clang-tidy", "--completion-style=detailed", "--function-arg-placeholders", "--pch-storage=memory",), "--version", "apt install clangd", "fast"),
    "zig": ("zls", "zls", (), "--version", "Download from https://github.com/zigtools/zls/releases", "fast"),
    "java": ("jdtls", "jdtls", (), "--version", "Download from https://download.eclipse.org/jdtls/snapshots/", "slow"),
    "kotlin": ("kotlin-lsp", "kotlin-lsp", ("--stdio",), "--help", "Download from https://github.com/JetBrains/kotlin-lsp/releases", "slow"),
    "scala": ("metals", "metals", (), "--version", "cs install metals", "slow"),
    "clojure": ("clojure-lsp", "clojure-lsp", (), "--version", "Download from https://github.com/clojure-lsp/clojure-lsp/releases", "standard"),
    "csharp": ("csharp-ls", "csharp-ls", (), "--version", "dotnet tool install -g csharp-ls", "standard"),
    "fsharp": ("fsautocomplete", "fsautocomplete", ("--adaptive-lsp-server-enabled", "--project-graph-enabled",), "--version", "dotnet tool install -g fsautocomplete", "standard"),
    "typescript": ("typescript-language-server", "typescript-language-server", ("--stdio",), "--version", "npm install -g typescript typescript-language-server", "slow"),
    "javascript": ("typescript-language-server", "typescript-language-server", ("--stdio",), "--version", "npm install -g typescript typescript-language-server", "slow"),
    "vue": ("vue-language-server", "vue-language-server", ("--stdio",), "--version", "npm install -g @vue/language-server", "standard"),
    "python": ("pyright", "pyright-langserver", ("--stdio",), "--version", "npm install -g pyright", "slow"),
    "ruby": ("ruby-lsp", "ruby-lsp", (), "--version", "gem install ruby-lsp", "standard"),
    "php": ("intelephense", "intelephense", ("--stdio",), "--version", "npm install -g intelephense", "standard"),
    "perl": ("PerlNavigator", "perlnavigator", ("--stdio",), "--version", "npm install -g perlnavigator-server", "standard"),
    "lua": ("lua-language-server", "lua-language-server", (), "--version", "Download from https://github.com/LuaLS/lua-language-server/releases", "standard"),
    "shellscript": ("bash-language-server", "bash-language-server", ("start",), "--version", "npm install -g bash-language-server", "standard"),
    "powershell": ("PowerShell EditorServices", "pwsh", ("-NoLogo", "-NoProfile", "-Command", "Import-Module PowerShellEditorServices; Start-EditorServices -HostName lorewalk -HostProfileId lorewalk -HostVersion 1.0.0 -BundledModulesPath $env:PSES_BUNDLE_PATH -Stdio",), "--version", "Install-Module -Name PowerShellEditorServices -Scope CurrentUser", "standard"),
    "haskell": ("haskell-language-server", "haskell-language-server-wrapper", ("--lsp",), "--version", "ghcup install hls", "slow"),
    "elixir": ("elixir-ls", "elixir-ls", (), "--version", "Download from https://github.com/elixir-lsp/elixir-ls/releases", "standard"),
    "erlang": ("erlang_ls", "erlang_ls", (), "--version", "Download from https://github.com/erlang-ls/erlang_ls/releases", "standard"),
    "elm": ("elm-language-server", "elm-language-server", (), "--version", "npm install -g @elm-tooling/elm-language-server", "standard"),
    "ocaml": ("ocamllsp", "ocamllsp", (), "--version", "opam install ocaml-lsp-server", "standard"),
    "go": ("gopls", "gopls", ("serve",), "version", "go install golang.org/x/tools/gopls@latest", "fast"),
    "swift": ("sourcekit-lsp", "sourcekit-lsp", (), "--version", "Download from https://swift.org/download/", "standard"),
    "dart": ("dart-language-server", "dart", ("language-server", "--protocol=lsp",), "--version", "apt install dart", "standard"),
    "terraform": ("terraform-ls", "terraform-ls", ("serve",), "--version", "Download from https://releases.hashicorp.com/terraform-ls/", "standard"),
    "yaml": ("yaml-language-server", "yaml-language-server", ("--stdio",), "--version", "npm install -g yaml-language-server", "standard"),
    "toml": ("taplo", "taplo", ("lsp", "stdio",), "--version", "cargo install taplo-cli --locked", "standard"),
    "nix": ("nil", "nil", (), "--version", "nix profile install nixpkgs#nil", "standard"),
    "rego": ("regal", "regal", ("language-server",), "version", "Download from https://github.com/StyraInc/regal/releases", "standard"),
    "r": ("R languageserver", "R", ("--slave", "-e", "languageserver::run()",), "--version", "R -e 'install.packages(\\", "standard"),
    "julia": ("LanguageServer.jl", "julia", ("--startup-file=no", "--history-file=no", "-e", "using LanguageServer; runserver()",), "--version", "julia -e 'using Pkg; Pkg.add(\\", "standard"),
    "fortran": ("fortls", "fortls", (), "--version", "pip install fortls", "standard"),
    "markdown": ("marksman", "marksman", ("server",), "--version", "Download from https://github.com/artempyanykh/marksman/releases", "standard"),
}

#: language: category, node type and example of its syntax nodes, in the order they are offered
NODE_TYPES = {
    "python": (
        ("class", "class_definition", "class MyClass:"),
        ("function", "function_definition", "def my_func():"),
        ("decorator", "decorated_definition", "@decorator def/class"),
        ("import", "import_statement", "import module"),
        ("import", "import_from_statement", "from x import y"),
        ("assignment", "assignment", "x = value"),
        ("if", "if_statement", "if condition:"),
        ("for", "for_statement", "for x in items:"),
        ("while", "while_statement", "while condition:"),
        ("try", "try_statement", "try: ... except:"),
        ("with", "with_statement", "with ctx as x:"),
        ("lambda", "lambda", "lambda x: x"),
    ),
    "typescript": (
        ("class", "class_declaration", "class MyClass {}"),
        ("class", "abstract_class_declaration", "abstract class X {}"),
        ("function", "function_declaration", "function myFunc() {}"),
        ("function", "arrow_function", "const fn = () => {}"),
        ("method", "method_definition", "myMethod() {}"),
        ("interface", "interface_declaration", "interface I {}"),
        ("type", "type_alias_declaration", "type T = ..."),
        ("enum", "enum_declaration", "enum E {}"),
        ("import", "import_statement", "import x from 'y'"),
        ("export", "export_statement", "export { x }"),
        ("variable", "lexical_declaration", "const/let x = ..."),
        ("variable", "variable_declaration", "var x = ..."),
    ),
    "javascript": (
        ("class", "class_declaration", "class MyClass {}"),
        ("function", "function_declaration", "function myFunc() {}"),
        ("function", "arrow_function", "const fn = () => {}"),
        ("function", "generator_function_declaration", "function* gen() {}"),
        ("method", "method_definition", "myMethod() {}"),
        ("import", "import_statement", "import x from 'y'"),
        ("export", "export_statement", "export { x }"),
        ("variable", "lexical_declaration", "const/let x = ..."),
        ("variable", "variable_declaration", "var x = ..."),
        ("if", "if_statement", "if (cond) {}"),
        ("for", "for_statement", "for (;;) {}"),
        ("for", "for_in_statement", "for (x in obj) {}"),
    ),
    "rust": (
        ("struct", "struct_item", "struct S {}"),
        ("enum", "enum_item", "enum E {}"),
        ("function", "function_item", "fn my_func() {}"),
        ("trait", "trait_item", "trait T {}"),
        ("impl", "impl_item", "impl T for S {}"),
        ("module", "mod_item", "mod my_mod {}"),
        ("use", "use_declaration", "use crate::x;"),
        ("type", "type_item", "type T = ...;"),
        ("const", "const_item", "const X: T = ...;"),
        ("static", "static_item", "static X: T = ...;"),
        ("macro", "macro_definition", "macro_rules! m {}"),
        ("attribute", "attribute_item", "#[derive(...)]"),
    ),
    "go": (
        ("struct", "struct_type", "type S struct {}"),
        ("interface", "interface_type", "type I interface {}"),
        ("function", "function_declaration", "func myFunc() {}"),
        ("method", "method_declaration", "func (r *R) M() {}"),
        ("type", "type_declaration", "type T ..."),
        ("type", "type_alias", "type T = Other"),
        ("import", "import_declaration", "import \"pkg\""),
        ("const", "const_declaration", "const X = ..."),
        ("var", "var_declaration", "var x = ..."),
        ("var", "short_var_declaration", "x := value"),
        ("if", "if_statement", "if cond {}"),
        ("for", "for_statement", "for i := range x {}"),
    ),
    "java": (
        ("class", "class_declaration", "class MyClass {}"),
        ("interface", "interface_declaration", "interface I {}"),
        ("enum", "enum_declaration", "enum E {}"),
        ("record", "record_declaration", "record R() {}"),
        ("method", "method_declaration", "void m() {}"),
        ("constructor", "constructor_declaration", "MyClass() {}"),
        ("field", "field_declaration", "private int x;"),
        ("import", "import_declaration", "import java.util.*;"),
        ("annotation", "annotation_type_declaration", "@interface A {}"),
        ("annotation", "annotation", "@Override"),
        ("if", "if_statement", "if (cond) {}"),
        ("for", "for_statement", "for (;;) {}"),
    ),
    "kotlin": (
        ("class", "class_declaration", "class MyClass {}"),
        ("object", "object_declaration", "object Singleton {}"),
        ("companion", "companion_object", "companion object {}"),
        ("function", "function_declaration", "fun myFunc() {}"),
        ("function", "anonymous_function", "fun() { ... }"),
        ("property", "property_declaration", "val/var x = ..."),
        ("import", "import_header", "import pkg.Class"),
        ("type", "type_alias", "typealias T = ..."),
        ("enum", "enum_entry", "enum class entries"),
        ("annotation", "annotation", "@Annotation"),
        ("if", "if_expression", "if (cond) {} else {}"),
        ("when", "when_expression", "when (x) {}"),
    ),
    "cpp": (
        ("class", "class_specifier", "class MyClass {}"),
        ("struct", "struct_specifier", "struct S {}"),
        ("function", "function_definition", "void f() {}"),
        ("namespace", "namespace_definition", "namespace ns {}"),
        ("template", "template_declaration", "template<T> ..."),
        ("enum", "enum_specifier", "enum E {}"),
        ("field", "field_declaration", "int member;"),
        ("typedef", "type_definition", "typedef ... T;"),
        ("concept", "concept_definition", "concept C = ..."),
        ("using", "using_declaration", "using ns::name;"),
        ("if", "if_statement", "if (cond) {}"),
        ("for", "for_statement", "for (;;) {}"),
    ),
    "csharp": (
        ("class", "class_declaration", "class MyClass {}"),
        ("interface", "interface_declaration", "interface I {}"),
        ("struct", "struct_declaration", "struct S {}"),
        ("enum", "enum_declaration", "enum E {}"),
        ("record", "record_declaration", "record R() {}"),
        ("method", "method_declaration", "void Method() {}"),
        ("constructor", "constructor_declaration", "MyClass() {}"),
        ("property", "property_declaration", "public int X { get; }"),
        ("field", "field_declaration", "private int _x;"),
        ("namespace", "namespace_declaration", "namespace Ns {}"),
        ("using", "using_directive", "using System;"),
        ("delegate", "delegate_declaration", "delegate void D();"),
    ),
    "shellscript": (
        ("function", "function_definition", "my_func() {}"),
        ("variable", "variable_assignment", "VAR=value"),
        ("if", "if_statement", "if cond; then"),
        ("case", "case_statement", "case $x in"),
        ("for", "for_statement", "for x in items; do"),
        ("while", "while_statement", "while cond; do"),
        ("for", "c_style_for_statement", "for ((i=0;;))"),
        ("pipeline", "pipeline", "cmd1 | cmd2"),
        ("command", "command", "echo hello"),
        ("redirect", "redirected_statement", "cmd > file"),
    ),
    "ruby": (
        ("class", "class", "class MyClass"),
        ("module", "module", "module MyModule"),
        ("method", "method", "def my_method"),
        ("method", "singleton_method", "def self.method"),
        ("lambda", "lambda", "-> { ... }"),
        ("block", "block", "do |x| ... end"),
        ("block", "do_block", "do ... end"),
        ("assignment", "assignment", "x = value"),
        ("if", "if", "if condition"),
        ("case", "case", "case value"),
        ("while", "while", "while condition"),
        ("for", "for", "for x in items"),
    ),
    "lua": (
        ("function", "function_definition", "function f() end"),
        ("function", "function_declaration", "local function f()"),
        ("variable", "variable_declaration", "local x = ..."),
        ("assignment", "assignment_statement", "x = value"),
        ("table", "table_constructor", "{ key = val }"),
        ("if", "if_statement", "if cond then end"),
        ("for", "for_statement", "for i=1,n do end"),
        ("for", "for_in_statement", "for k,v in pairs()"),
        ("while", "while_statement", "while cond do end"),
        ("repeat", "repeat_statement", "repeat until cond"),
    ),
    "php": (
        ("class", "class_declaration", "class MyClass {}"),
        ("interface", "interface_declaration", "interface I {}"),
        ("trait", "trait_declaration", "trait T {}"),
        ("enum", "enum_declaration", "enum E {}"),
        ("function", "function_definition", "function f() {}"),
        ("method", "method_declaration", "public function m()"),
        ("namespace", "namespace_definition", "namespace Ns;"),
        ("use", "namespace_use_declaration", "use Ns\\Class;"),
        ("property", "property_declaration", "public $x;"),
        ("const", "const_declaration", "const X = ...;"),
        ("if", "if_statement", "if ($cond) {}"),
        ("foreach", "foreach_statement", "foreach ($x as $y)"),
    ),
}

#: Names that are never searched, whatever the project says; those with a star are endings.
IGNORED_NAMES = (
    ".git", ".svn", ".hg", ".gitmodules", "node_modules", "vendor", ".venv", "venv", "env", "__pycache__", ".pnp", ".yarn", "target", "dist", "build", "out", ".next",
    ".nuxt", ".output", "coverage", ".gradle", ".m2", "gradle-wrapper.jar", ".idea", ".vscode", ".fleet", "*.swp", "*.swo", ".cache", ".parcel-cache", ".turbo",
    ".eslintcache", ".prettiercache", "generated", "gen", ".generated", ".pytest_cache", ".tox", "htmlcov", "logs", "*.log", "tmp", "temp", ".lorewalk",
)

#: Default limits: references, all other lists; 0 is none.
LIMITS = {"refs": 500, "symbols": 100, "impl": 100, "calls": 100, "search": 100}

# Tables ---------------------------------------------------------------------------


def kinds(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, k, k in TYPE_KINDS, k in CALLABLE_KINDS, k in LOW_LEVEL_KINDS, k not in LOW_LEVEL_KINDS) for i, k in enumerate(KINDS)]
    return spark.createDataFrame(rows, "kind_id int, kind string, is_type boolean, is_callable boolean, is_low_level boolean, is_structural boolean")


def kind_names(spark: SparkSession) -> DataFrame:
    """Names that a kind answers to."""
    return spark.createDataFrame([(k, k) for k in NAMED_KINDS] + list(KIND_ALIASES.items()), "name string, kind string")


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, n, e.split(), a.split(), d.split()) for i, n, e, a, d in LANGUAGES]
    return spark.createDataFrame(rows, "language string, shown string, extensions array<string>, names array<string>, ignored array<string>")


def extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, _, e, _, _ in LANGUAGES for x in e.split()], "ext string, language string")


def capabilities(spark: SparkSession) -> DataFrame:
    """A level for each language (and for others, `unknown`) and feature."""
    rows = []
    for language in [i for i, *_ in LANGUAGES] + ["unknown"]:
        rows += [(language, f, support_level(language, f)) for f, _, _ in FEATURES]
    return spark.createDataFrame(rows, "language string, feature string, level string")


#: What to do instead where a language lacks a feature; any other one has nothing better.
INSTEAD = {
    "rename": "search the text for the name",
    "find_implementations": "find the references, or search the text for the name",
    "incoming_calls": "find the references, or search the text for the name",
    "outgoing_calls": "find the references of what may be called",
}


def support_level(language: str, feature: str) -> str:
    """full, partial or none."""
    level, other = SUPPORT.get(language, (OTHER_SUPPORT, {}))
    return other.get(feature, level)


def unsupported_message(language: str, feature: str) -> str:
    """What to say where a language's server lacks a feature, and what to do instead."""
    shown = next((n for i, n, *_ in LANGUAGES if i == language), language)
    server = SERVERS[language][0] if language in SERVERS else "its server"
    asked = next(n for f, n, _ in FEATURES if f == feature)
    instead = INSTEAD.get(feature)
    return f"{shown} ({server}) does not support '{asked}'" + (f"; {instead}" if instead else "")


def unsupported(spark: SparkSession) -> DataFrame:
    """language, feature and message of what is not supported."""
    rows = [(i, f, unsupported_message(i, f)) for i, *_ in LANGUAGES for f, _, _ in FEATURES if support_level(i, f) == "none"]
    return spark.createDataFrame(rows, "language string, feature string, message string")


def features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEATURES), "feature string, shown string, command string")


def file_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILE_TYPES.items()), "alias string, type string")


def servers(spark: SparkSession) -> DataFrame:
    rows = [(lang, server, command, list(args), version, install, tier, *TIERS[tier]) for lang, (server, command, args, version, install, tier) in SERVERS.items()]
    return spark.createDataFrame(rows, "language string, server string, command string, args array<string>, version_arg string, install string, tier string, init_s int, request_s int, cross_file_s int, shutdown_s int")


def node_types(spark: SparkSession) -> DataFrame:
    rows = [(lang, k, *x) for lang, v in NODE_TYPES.items() for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "language string, ord int, category string, node_type string, example string")


def syntax_supported(language: str) -> bool:
    """Whether syntax nodes of a language are known."""
    return language in NODE_TYPES


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(i, *PROFILES.get(i, OTHER_PROFILE)) for i, *_ in LANGUAGES]
    return spark.createDataFrame(rows, "language string, factor double, indexing_ms int, cross_file_ms int, aggressive boolean")


def operations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, list(m)) for n, (f, m) in OPERATIONS.items()], "operation string, factor double, methods array<string>")
