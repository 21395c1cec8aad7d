"""Syntax trees of the known languages, and patterns over them."""

import pytest

from lorewalk import dims
from lorewalk.operators import ast
from lorewalk.sources import syntax

CODE = {
    "rust": """#[derive(Debug)]
pub struct Point { x: i32 }
enum Kind { A, B }
use std::io;
type Id = u64;
const LIMIT: usize = 9;
static NAME: &str = "fn not() {";
macro_rules! twice { ($x:expr) => { $x * 2 }; }
mod inner { pub fn deep() {} }
trait Shape { fn area(&self) -> f64; }
impl Shape for Point {
    // fn comment() {}
    fn area(&self) -> f64 { 1.0 }
}
fn hello<'a>(x: &'a str) -> char { 'x' }
pub async fn world() -> i32 { 1 }
""",
    "go": """package a
import "fmt"
import (
	"os"
)
const X = 1
var y = 2
type Alias = int
type S struct {
	a int
}
type I interface{ M() }
func (s *S) M() { fmt.Println("func no() {}") }
func run() {
	z := 1
	if z > 0 { return }
	for i := range []int{1} { _ = i }
}
""",
    "java": """package a;
import java.util.*;
@interface Mark {}
public class A extends B {
    private int count = 0;
    public A(int x) { this.count = x; }
    @Override
    public String name(int a) throws E { if (a > 0) { return "class X {}"; } for (;;) {} }
}
interface I { void run(); }
enum E2 { P, Q }
record R(int a) {}
""",
    "kotlin": """import a.b
typealias T = Int
data class P(val x: Int)
object One { val y = 2 }
class Q {
    companion object { const val Z = 1 }
    @Mark
    fun run(a: Int): Int {
        if (a > 0) { return 1 }
        return when (a) { 0 -> 1
            else -> 2 }
    }
    fun short() = 3
}
val f = fun(x: Int) { }
""",
    "cpp": """#include <a>
using std::string;
typedef int Number;
namespace n {
template <class T> T first(T a) { return a; }
struct S { int member; };
class C {
  int field = 1;
  void go() { if (field) { } for (;;) { } }
};
enum class E { A };
}
int main(int argc, char** argv) { return 0; }
concept K = true;
""",
    "csharp": """using System;
namespace N {
    public class A {
        private int _x = 1;
        public int X { get; set; }
        public A(int x) { _x = x; }
        public void Run(int a) { if (a > 0) { } }
    }
    interface I { void M(); }
    struct S { }
    enum E { P }
    record R(int a);
    delegate void D(int a);
}
""",
    "php": """<?php
namespace App;
use Other\\Thing;
interface I {}
trait T {}
enum E {}
class A {
    public $x = 1;
    const Y = 2;
    public function m() { if ($a) { } foreach ($a as $b) { } }
}
function f() {}
""",
    "javascript": """import x from 'y';
export const a = 1;
var old = 2;
let g = (p) => p + 1;
class A { go(x) { if (x) { } } }
function f() { for (const k in o) { } for (let i = 0; i < 3; i++) { } }
function* gen() { yield 1; }
""",
    "typescript": """import { x } from 'y';
interface I { a: number }
type T = string | number;
enum E { A }
abstract class B { run(): void { } }
class A extends B { go(x: number): void { return; } }
export function f(a: number): number { return a; }
const h = (p: number): number => p;
""",
    "shellscript": """# if comment
NAME=value
greet() { echo hello; }
if [ -f x ]; then
  cat x | sort
fi
for i in 1 2; do
  echo $i > out
done
for ((i=0;i<3;i++)); do :; done
while true; do break; done
case $x in a) ;; esac
""",
    "ruby": """module M
  class A
    def run(x)
      y = 1
      if x
        [1].each do |z|
          puts z
        end
      end
      case x
      when 1 then 2
      end
      while x
      end
    end
    def self.make
      [1].map { |q| q }
    end
  end
end
f = -> { 1 }
for i in 1..2
end
""",
    "lua": """local x = 1
y = 2
local function f(a)
  if a then return { k = 1 } end
  for i = 1, 3 do end
  for k, v in pairs(t) do end
  while a do end
  repeat until a
end
function M.g() end
local h = function() end
""",
}
COUNTS = {
    "rust": {"function_item": 4, "function_signature_item": 1, "attribute_item": 1},
    "go": {"struct_type": 1, "type_declaration": 3, "import_declaration": 2, "for_statement": 1},
    "java": {"method_declaration": 2, "annotation": 1},
    "kotlin": {"function_declaration": 2, "class_declaration": 2, "property_declaration": 3},
    "cpp": {"function_definition": 3, "field_declaration": 1},
    "csharp": {"method_declaration": 2},
    "php": {"method_declaration": 1, "function_definition": 1},
    "javascript": {"method_definition": 1, "lexical_declaration": 3, "function_declaration": 1},
    "typescript": {"class_declaration": 1, "method_definition": 2},
    "shellscript": {"for_statement": 1, "if_statement": 1, "pipeline": 1},
    "ruby": {"method": 1, "singleton_method": 1, "if": 1},
    "lua": {"function_declaration": 2, "function_definition": 1},
}


@pytest.mark.parametrize("language", CODE)
def test_outline_finds_every_listed_type(language):
    t = syntax.tree(CODE[language], language)
    counts = {k: t.types.count(k) for k in t.types}
    listed = {n for _, n, _ in dims.NODE_TYPES[language]}
    absent = {"enum_entry", "variable_declaration"} if language in ("kotlin", "typescript") else {"annotation"} if language == "kotlin" else set()
    if language == "typescript":
        absent |= {"lexical_declaration"} - counts.keys()
    assert listed - counts.keys() <= absent, listed - counts.keys()
    for kind, n in COUNTS[language].items():
        assert counts.get(kind, 0) == n, (kind, counts)
    for k, p in enumerate(t.parents):  # children lie in their parents
        assert p is None or (t.starts[p] <= t.starts[k] and t.ends[k] <= t.ends[p])


def texts(language, content, pattern):
    t = syntax.tree(content, language)
    return [[(c, t.text(n)) for n, c in held] for held in ast.Matcher(ast.parse(ast.normalized(pattern)), t).matches()]


def test_bodies_end_where_blocks_do():
    rust = CODE["rust"]
    assert [m[0][1] for m in texts("rust", rust, "function_item")][-2:] == ["fn hello<'a>(x: &'a str) -> char { 'x' }", "pub async fn world() -> i32 { 1 }"]
    assert texts("rust", rust, "(impl_item (function_item name: (identifier) @n))") == [[("n", "area")]]
    assert texts("lua", CODE["lua"], "(function_declaration name: (identifier) @n) @f")[1] == [("f", "function M.g() end"), ("n", "M.g")]
    assert texts("ruby", CODE["ruby"], "(class (method name: (identifier) @n))") == [[("n", "run")]]
    assert [m[0][1] for m in texts("shellscript", CODE["shellscript"], "if_statement")] == ["if [ -f x ]; then\n  cat x | sort\nfi"]


PY = "import os\nimport re\nx = f(1)\n\nclass A(B):\n    def f(self):\n        return 1\n\n    @cached\n    def g(self):\n        y = lambda: 2\n        return y\n"


def test_fields_groups_quantifiers_and_anchors():
    find = lambda p: texts("python", PY, p)
    assert [m[0][1] for m in find('((identifier) @a (#eq? @a "f"))')] == ["f", "f"]
    assert find("(function_definition name: (identifier) @n)") == [[("n", "f")], [("n", "g")]]
    assert find("(call function: (identifier) @c)") == [[("c", "f")]]
    assert find("(import_statement)+ @all") == [[("all", "import os"), ("all", "import re")]]
    assert find("(module . (import_statement) @first)") == [[("first", "import os")]]
    assert find("(module (class_definition) @last .)")[0][0][0] == "last" and find("(module (import_statement) @last .)") == []
    assert find("((import_statement) @a . (import_statement) @b)") == [[("a", "import os"), ("b", "import re")]]
    assert len(find("(module (import_statement) @a (_) @b)")) == 5
    assert [len(m) for m in find("(function_definition (assignment)? @x (return_statement) @r)")] == [1, 2]
    assert find("(function_definition (assignment) @a (return_statement) @r)") == [[("a", "y = lambda: 2"), ("r", "return y")]]
    assert len(find("[(import_statement) (lambda)] @x")) == 3 and len(find("(decorated_definition definition: (function_definition) @d)")) == 1
    assert find('(function_definition name: (identifier) @n (#not-eq? @n "f"))') == [[("n", "g")]]
    assert find('(function_definition name: (identifier) @n (#any-of? @n "h" "g"))') == [[("n", "g")]] and find('(import_statement) @i (#match? @i "re$")') == [[("i", "import re")]]
    assert len(find("(class_definition !name) @c")) == 0 and len(find("(import_statement) @a (lambda) @b")) == 3
    assert find("((import_statement)* @a (assignment) @b)")[0] == [("a", "import os"), ("a", "import re"), ("b", "x = f(1)")]


def test_what_is_no_pattern():
    for bad in ("", "(a (b)", "(a))", "(a) $x", "[]", "()", '(a) @x (#same? @x "y")', '(a) @x (#eq? @y "z")', "(a) @x (#eq? @x)", "[(a) .] @x"):
        with pytest.raises(ValueError):
            ast.parse(bad)
    assert "(struct_item)" in ast.query_error("rust", "x") and "no syntax search" in ast.query_error("elm", "x")


def test_html():
    t = syntax.tree('<ul><li>é</li>\n<li><br>b</ul><script>"</p>"</script>', "html")
    assert [(t.types[k], *t.place(k), t.text(k)) for k in (1, 2)] == [("li", 1, 1, 4, 15, "<li>é</li>"), ("li", 2, 2, 0, 9, "<li><br>b")]
    assert t.types == ["ul", "li", "li", "br", "script"]


def test_nodes_and_files_give_the_same_matches(spark):
    files = spark.createDataFrame([("a.py", PY), ("bad.py", "def ("), ("none.py", None), ("empty.py", "")], "file string, content string")
    nodes = syntax.nodes(files, "python").cache()
    for pattern in ("function_definition", "(class_definition (function_definition name: (identifier) @n)) @c", '((identifier) @a (#eq? @a "f"))'):
        one, two = (sorted(map(str, df.collect())) for df in (ast.search_ast(nodes, pattern), ast.search_files(files, pattern, "python")))
        assert one == two and one
    assert ast.search_ast(nodes.drop("field"), "(_ (return_statement) @r)").count() == 2 and ast.search_files(files, "identifier", "python", limit=1).count() == 1
    with pytest.raises(ValueError):
        ast.search_files(files, "x", "cobol")


def test_a_long_text_that_many_matches_share_is_held_once(spark):
    code = "class A:\n" + "".join(f"    def f{k}(self):\n        return {k}\n" for k in range(400))
    query = "(class_definition (function_definition name: (identifier) @n)) @c"
    frames = list(ast._frames(iter([("f", 1, 1, 0, 0, code * 100, [{"name": "c", "text": code * 100}])] * 9)))
    assert sum(map(len, frames)) == 9 and max(map(len, frames)) <= 1 + ast.CHARACTERS // (200 * len(code))
    files = spark.createDataFrame([("f", code)], "file string, content string")
    every, some = (ast.search_files(files, query, "python", texts=texts).collect() for texts in (None, ["n"]))
    assert len(every) == len(some) == 400
    assert all(r.text == r.captures[0].text and r.text.startswith("class A") for r in every)
    assert [r.captures[1].text for r in some] == [r.captures[1].text for r in every] == [f"f{k}" for k in range(400)]
    assert {(r.text, r.captures[0].name, r.captures[0].text) for r in some} == {(None, "c", None)}
