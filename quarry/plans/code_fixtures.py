"""Code and tool output, with the rows that they must give, worked out by hand. Queries fill in
the key of a table's row behind names, so there is one of each for every row."""

from __future__ import annotations

from quarry.functions.schemas import KNOWN_SYMBOLS

PY_PROJECT = {
    "shop/prices.py": '''
def net(price: float, rate) -> float:
    return price / (1 + rate)

def label(price):
    def inner(x):
        return str(x)
    return inner(net(price, 0.2))

async def fetch(url: str, *, timeout=10) -> list[str]:
    await client.get(url)
    return label(len(url))
''',
    "shop/cart.py": '''
from shop.prices import net

class Base:
    pass

class Cart(Base, abc.Mixin):
    limit = max(1, 2)

    def __init__(self, owner: "User"):
        self.items = []

    @cached(seconds=5)
    def total(self, rate: float | None = default()) -> float:
        self.total(rate)
        return net(sum(self.items), rate)

    class Line:
        def cost(self):
            return Cart.total(self)

Cart("me").total(0)
''',
    "shop/broken.py": "def oops(:\n",
}
PY_NODES = [
    ("shop/prices.py", "net", "function", 2, "def net(price: float, rate) -> float"),
    ("shop/prices.py", "label", "function", 5, "def label(price)"),
    ("shop/prices.py", "inner", "function", 6, "def inner(x)"),
    ("shop/prices.py", "fetch", "function", 10, "async def fetch(url: str) -> list[str]"),
    ("shop/cart.py", "Base", "class", 4, "class Base"),
    ("shop/cart.py", "Cart", "class", 7, "class Cart(Base, abc.Mixin)"),
    ("shop/cart.py", "Cart.__init__", "method", 10, "def __init__(self, owner: User)"),
    ("shop/cart.py", "Cart.total", "method", 14, "def total(self, rate: ) -> float"),
    ("shop/cart.py", "Line", "class", 18, "class Line"),
    ("shop/cart.py", "Line.cost", "method", 19, "def cost(self)"),
]
PY_EDGES = [
    ("shop/prices.py", "inner", "str", "calls", 7),
    ("shop/prices.py", "label", "inner", "calls", 8),
    ("shop/prices.py", "label", "net", "calls", 8),
    ("shop/prices.py", "fetch", "client.get", "calls", 11),
    ("shop/prices.py", "fetch", "label", "calls", 12),
    ("shop/prices.py", "fetch", "len", "calls", 12),
    ("shop/cart.py", "Cart", "Base", "inherits", 7),
    ("shop/cart.py", "Cart", "abc.Mixin", "inherits", 7),
    ("shop/cart.py", "Cart.total", "cached", "calls", 13),
    ("shop/cart.py", "Cart.total", "default", "calls", 14),
    ("shop/cart.py", "Cart.total", "self.total", "calls", 15),
    ("shop/cart.py", "Cart.total", "net", "calls", 16),
    ("shop/cart.py", "Cart.total", "sum", "calls", 16),
    ("shop/cart.py", "Line.cost", "Cart.total", "calls", 20),
]

TS_PROJECT = {
    "web/model.ts": """
export interface Item {
  title: string;
  readonly price?: number;
  describe(short: boolean): string;
}

export type Key = string | number;

export enum State {
  Open,
  Closed = 2,
  Lost
}
""",
    "web/shop.ts": """
import { Item, Key } from './model';
import tools, { trim as cut } from "tools";

@Injectable({ root: true })
class Shop {
  private items: Map<Key, Item> = new Map();

  find(key: Key): Item | undefined {
    return this.items.get(key);
  }

  private async load(url: string, ...rest: string[]): Promise<void> {
    const raw = await request(parse(url));
    this.items.set(raw.key, raw);
  }
}

export const show = (item: Item): string => {
  return cut(`${describe(item)}: ${item.price}`);
};

export async function main(): Promise<void> {
  const shop = new Shop();
  console.log(shop.find("a"));
}

main();
""",
    "web/util.js": """
const { join } = require('path');

function twice(x) {
  return x * 2;
}

class Box {
  open(lid) {
    return twice(lid);
  }
}

module.exports = { twice, Box };
""",
}
TS_NODES = [
    ("web/model.ts", "Item", "interface", 2, "interface Item"),
    ("web/model.ts", "Item.title", "property", 3, "title: string"),
    ("web/model.ts", "Item.price", "property", 4, "price: number"),
    ("web/model.ts", "Item.describe", "method", 5, "describe(short: boolean) -> string"),
    ("web/model.ts", "Key", "type", 8, "type Key = string | number"),
    ("web/model.ts", "State", "enum", 10, "enum State"),
    ("web/model.ts", "State.Open", "enum_member", 11, "Open"),
    ("web/model.ts", "State.Lost", "enum_member", 13, "Lost"),
    ("web/shop.ts", "Item", "import", 2, "import { Item }"),
    ("web/shop.ts", "Key", "import", 2, "import { Key }"),
    ("web/shop.ts", "trim", "import", 3, "import { trim }"),
    ("web/shop.ts", "Shop", "class", 6, "class Shop"),
    ("web/shop.ts", "Shop.find", "method", 9, "find(key: Key) -> Item | undefined"),
    ("web/shop.ts", "Shop.load", "method", 13, "private async load(url: string, ...rest: string[]) -> Promise<void>"),
    ("web/shop.ts", "show", "function", 19, "const show = (item: Item) => ..."),
    ("web/shop.ts", "main", "function", 23, "async function main() -> Promise<void>"),
    ("web/util.js", "twice", "function", 4, "function twice(x)"),
    ("web/util.js", "Box", "class", 8, "class Box"),
    ("web/util.js", "Box.open", "method", 9, "open(lid)"),
]
TS_EDGES = [
    ("web/shop.ts", "(module)", "./model", "imports", 2),
    ("web/shop.ts", "(module)", "tools", "imports", 3),
    ("web/shop.ts", "Shop", "Injectable", "decorates", 5),
    ("web/shop.ts", "Shop.find", "this.items.get", "calls", 10),
    ("web/shop.ts", "Shop.load", "request", "calls", 14),
    ("web/shop.ts", "Shop.load", "parse", "calls", 14),
    ("web/shop.ts", "Shop.load", "this.items.set", "calls", 15),
    ("web/shop.ts", "show", "cut", "calls", 20),
    ("web/shop.ts", "show", "describe", "calls", 20),
    ("web/shop.ts", "main", "console.log", "calls", 25),
    ("web/shop.ts", "main", "shop.find", "calls", 25),
    ("web/util.js", "Box.open", "twice", "calls", 10),
]

IMPORT_PROJECT = {
    "aaa/core.py": "def run():\n    pass\n\ndef helper():\n    pass\n",
    "pkg/__init__.py": "from .core import run as start\nfrom .more import *\n",
    "pkg/core.py": "def run():\n    helper()\n\ndef helper():\n    run()\n\nclass Tool:\n    def use(self):\n        return helper()\n",
    "pkg/more.py": "from ..top import deep\nfrom . import core\n\ndef extra():\n    deep()\n    core.run()\n",
    "top.py": "def deep():\n    pass\n",
    "app/main.py": """
import pkg.core as c
import pkg.core
from pkg import start, extra as more
from pkg.core import helper as h, Tool
from lost import nothing

def main():
    start()
    more()
    c.run()
    pkg.core.helper()
    h()
    Tool.use(1)
    nothing()
    deep()

def own():
    main()
""",
    "web/main.ts": """
import start, { make as build, type Shape } from './lib';
import * as lib from "./lib";
const { cut: trim } = require('./lib/cut');

function run() {
  start();
  build(1);
  lib.make(2);
  lib.spare();
  trim();
  missing();
}
""",
    "web/lib/index.ts": "export { make } from './make';\nexport * from './spare';\nexport { begin as default } from './make';\n",
    "web/lib/make.ts": "export function make(n: number) { local(); }\nfunction local() {}\nexport function begin() {}\n",
    "web/lib/spare.ts": "import { make } from '../lib';\nexport function spare() { make(1); }\n",
    "web/lib/cut.js": "function cut() {}\nmodule.exports = { cut };\n",
}
IMPORT_EDGES = [
    ("pkg/core.py", "run", "pkg/core.py", "helper", 2),
    ("pkg/core.py", "helper", "pkg/core.py", "run", 5),
    ("pkg/core.py", "Tool.use", "pkg/core.py", "helper", 9),
    ("pkg/more.py", "extra", "top.py", "deep", 5),
    ("pkg/more.py", "extra", "pkg/core.py", "run", 6),
    ("app/main.py", "main", "pkg/core.py", "run", 9),
    ("app/main.py", "main", "pkg/more.py", "extra", 10),
    ("app/main.py", "main", "pkg/core.py", "run", 11),
    ("app/main.py", "main", "pkg/core.py", "helper", 12),
    ("app/main.py", "main", "pkg/core.py", "helper", 13),
    ("app/main.py", "main", "pkg/core.py", "Tool.use", 14),
    ("app/main.py", "own", "app/main.py", "main", 19),
    ("web/main.ts", "run", "web/lib/make.ts", "begin", 7),
    ("web/main.ts", "run", "web/lib/make.ts", "make", 8),
    ("web/main.ts", "run", "web/lib/make.ts", "make", 9),
    ("web/main.ts", "run", "web/lib/spare.ts", "spare", 10),
    ("web/main.ts", "run", "web/lib/cut.js", "cut", 11),
    ("web/lib/make.ts", "make", "web/lib/make.ts", "local", 1),
    ("web/lib/spare.ts", "spare", "web/lib/make.ts", "make", 2),
]

HERITAGE_PROJECT = {
    "web/shape.ts": """
import legacy = require("./legacy");
interface Shape extends Item, Key {
}
class Box extends Shop<Item> implements Shape {
}
class Alone {}
""",
}
HERITAGE_EDGES = [
    ("web/shape.ts", "(module)", "./legacy", "imports", 2),
    ("web/shape.ts", "Shape", "Item", "extends", 3),
    ("web/shape.ts", "Shape", "Key", "extends", 3),
    ("web/shape.ts", "Box", "Shop<Item>", "extends", 5),
    ("web/shape.ts", "Box", "Shape", "implements", 5),
]

SYMBOL_FILE = {
    "lib/sample.py": '''
"""A module."""

LIMIT = 3
rate: float = 0.5

class Reader(Base):
    """Reads."""

    size = 1

    def read(self, n: int) -> bytes:
        """Reads n."""
        def step():
            pass
        return b""

async def load(path: str, deep: dict) -> bool:
    return True
''',
}
PY_SYMBOLS = [
    ("lib/sample.py", "LIMIT", "variable", 4, "", ""),
    ("lib/sample.py", "rate", "variable", 5, "", ""),
    ("lib/sample.py", "Reader", "class", 7, "class Reader(Base)", ""),
    ("lib/sample.py", "read", "method", 12, "def read(self, n: int) -> bytes", "Reader"),
    ("lib/sample.py", "step", "method", 14, "def step()", "read"),
    ("lib/sample.py", "load", "function", 18, "async def load(path: str, deep: dict) -> bool", ""),
]

DTS_FILE = {
    "types/api.d.ts": """
export declare function fetchAll(url: string, n: number): Promise<string>;
declare function stop();
export declare class Service extends Core implements A, B {
}
export interface Options extends Base {
}
export declare const VERSION: string;
export type Answer = string | null;
export declare enum Mode {
}
""",
}
DTS_SYMBOLS = [
    ("types/api.d.ts", "fetchAll", "function", 2, "function fetchAll(url: string, n: number): Promise<string>", ""),
    ("types/api.d.ts", "stop", "function", 3, "function stop(): void", ""),
    ("types/api.d.ts", "Service", "class", 4, "class Service extends Core implements A, B", ""),
    ("types/api.d.ts", "Options", "interface", 6, "interface Options extends Base", ""),
    ("types/api.d.ts", "VERSION", "const", 8, "const VERSION = string", ""),
    ("types/api.d.ts", "Answer", "type", 9, "type Answer = string | null", ""),
    ("types/api.d.ts", "Mode", "enum", 10, "enum Mode", ""),
]

TEST_FILES = {
    "tests/test_a.py": "from x import process\n\ndef test_it():\n    assert svc.process(1)\n",
    "tests/deep/test_b.py": "helper = 1\n",
    "tests/test_c.py": "text = 'process helper'\n",
    "tests/test_d.py": "def broken(:\n",
    "src/test_e.py": "helper()\n",
    "tests/helper_f.py": "helper()\n",
}
TEST_FILES_HIT = [("tests/test_a.py",), ("tests/deep/test_b.py",)]

KNOWN_ROWS = [(library, s) for library, names in KNOWN_SYMBOLS.items() for s in names.split()]

LISTINGS = [
    ("main", '[{"name":"code-review","type":"dir","html_url":"u1"},{"name":".hidden","type":"dir"},{"name":"README.md","type":"file"},{"name":"sql_tuning","type":"dir"}]', 0),
    ("extra", '[{"name":"code-review","type":"dir","html_url":"u2"}]', 1),
    ("down", "not json", 2),
]
CATALOG_ROWS = [
    ("code-review", "main", "Code Review", "u1"),
    ("sql_tuning", "main", "Sql Tuning", ""),
    ("code-review", "extra", "Code Review", "u2"),
]

TSC_OUTPUT = "src/a.ts(3,14): error TS2322: Type 'x' is not assignable.\nsrc/b.ts(9,1): warning: unused error\nFound 2 problems.\nsrc/c.ts(1,2,3): error TS1: odd\nsrc/d.ts(q,5): note\n"
TSC_ISSUES = [
    (3, 14, "tsc", "error TS2322: Type 'x' is not assignable.", "error"),
    (9, 1, "tsc", "warning: unused error", "warning"),
    (None, 5, "tsc", "note", "warning"),
]
MYPY_OUTPUT = "a.py:3: error: Incompatible types\na.py:4:7: note: an error here: really\n\nno parts\na.py:x:y: odd: one: two"
MYPY_ISSUES = [
    (3, None, "mypy", "Incompatible types", "warning"),
    (4, 7, "mypy", "note:  an error here: really", "warning"),
    (None, None, "mypy", "odd:  one: two", "warning"),
]
RUFF_OUTPUT = '[{"code":"F401","message":"unused","location":{"row":1,"column":8}},{"code":"E501","text":"long","location":{"line":2,"col":3}},{"message":"bare","location":7},{"code":"X1","message":"none"}]'
RUFF_ISSUES = [
    (1, 8, "F401", "unused", "warning"),
    (2, 3, "E501", "long", "warning"),
    (7, None, "RUFF", "bare", "warning"),
    (None, None, "X1", "none", "warning"),
]
ESLINT_OUTPUT = '[{"filePath":"a","messages":[{"line":1,"column":2,"ruleId":"semi","message":"Missing","severity":2},{"line":3,"column":4,"ruleId":null,"message":"Odd","severity":1}]},{"filePath":"b"}]'
ESLINT_ISSUES = [
    (1, 2, "semi", "Missing", "error"),
    (3, 4, None, "Odd", "warning"),
]

CHECKED = {
    "ok.py": "import os\nprint(os.sep)\n",
    "bad.py": "x = 1\ndef f(:\n",
    "lost.py": "import json\nimport no_such_module_here\nfrom another_lost_one.sub import x\nfrom . import y\n",
}
SYNTAX_ROWS = [("bad.py", 2, "SyntaxError", "error")]
IMPORT_ROWS = [
    ("bad.py", None, "SKIP", "Cannot check imports: syntax errors present", "warning"),
    ("lost.py", 2, "ImportError", "Module 'no_such_module_here' not found", "warning"),
    ("lost.py", 3, "ImportError", "Module 'another_lost_one.sub' not found", "warning"),
]
REPORT_ROWS = [
    ("ok.py", "pass", True, "All checks passed"),
    ("bad.py", "fail", False, "1 error(s), 1 warning(s)"),
    ("lost.py", "warn", True, "0 error(s), 1 warning(s)"),
]

LINTED = "import os\nimport sys as system\nfrom a import b, c\nc()\ntry:\n    x = 1\nexcept:\n    x == None\n" + "y = '" + "z" * 130 + "'\n"
LINT_ROWS = [
    (1, 1, "F401", "warning"),
    (2, 1, "F401", "warning"),
    (3, 1, "F401", "warning"),
    (7, 1, "E722", "warning"),
    (8, 5, "E711", "warning"),
    (9, 121, "E501", "warning"),
]
