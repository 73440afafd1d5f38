"""Tags given to source text by the substrings it contains.

Each tag lists alternatives; an alternative holds when all of its substrings
occur in the lower-cased text.
"""

TAGS_BY_LANGUAGE: dict[str, list[tuple[str, list[list[str]]]]] = {
    "javascript typescript": [
        ("async_await_pattern", [["async", "await"]]),
        ("promise_pattern", [["promise"]]),
        ("promise_chaining", [[".then("]]),
        ("react_hooks", [["usestate"]]),
        ("react_effects", [["useeffect"]]),
        ("generator_pattern", [["function*"]]),
        ("class_pattern", [["class "]]),
        ("arrow_functions", [["=>"]]),
        ("error_handling", [["try", "catch"]]),
        ("api_integration", [["fetch("], ["axios"]]),
        ("functional_programming", [["map("], ["filter("]]),
    ],
    "python": [
        ("function_definition", [["def "]]),
        ("class_definition", [["class "]]),
        ("async_functions", [["async def"]]),
        ("context_manager", [["with "]]),
        ("exception_handling", [["try:", "except"]]),
        ("list_comprehension", [["[", "for", "in"]]),
        ("decorators", [["@"]]),
        ("generator_pattern", [["yield"]]),
        ("constructor_pattern", [["__init__"]]),
        ("module_imports", [["import "]]),
    ],
    "rust": [
        ("function_definition", [["fn "]]),
        ("struct_definition", [["struct "]]),
        ("enum_definition", [["enum "]]),
        ("implementation_block", [["impl "]]),
        ("trait_definition", [["trait "]]),
        ("pattern_matching", [["match "]]),
        ("conditional_binding", [["if let"]]),
        ("unwrap_pattern", [["unwrap()"]]),
        ("error_propagation", [["?", "result"]]),
        ("async_functions", [["async fn"]]),
        ("await_pattern", [[".await"]]),
        ("module_imports", [["use "]]),
        ("mutable_binding", [["mut "]]),
        ("borrowing_pattern", [["&", "ref"], ["&", "borrow"]]),
        ("clone_pattern", [["clone()"]]),
        ("smart_pointers", [["box<"], ["rc<"], ["arc<"]]),
        ("lifetime_annotations", [["lifetime"], ["'"]]),
        ("unsafe_code", [["unsafe"]]),
        ("macro_definition", [["macro_rules!"]]),
        ("vector_initialization", [["vec!["]]),
        ("iterator_pattern", [[".iter()"], [".map("], [".filter("]]),
        ("concurrency_pattern", [["thread::"], ["spawn("]]),
    ],
}

TAGS_ANY_LANGUAGE: list[tuple[str, list[list[str]]]] = [
    ("conditional_logic", [["if "]]),
    ("iteration_pattern", [["for "], ["while "]]),
    ("return_pattern", [["return "]]),
    ("factory_pattern", [["factory"]]),
    ("singleton_pattern", [["singleton"]]),
    ("observer_pattern", [["observer"]]),
    ("strategy_pattern", [["strategy"]]),
]

# Tags that raise the skill level.
ADVANCED_TAGS = ["async_await_pattern", "generator_pattern", "decorators", "context_manager"]
INTERMEDIATE_TAGS = ["class_pattern", "error_handling", "promise_pattern"]

# A text with more lines than this is a large block; with more functions, a module of many functions.
LARGE_BLOCK_LINES = 50
MANY_FUNCTIONS = 5
