"""Which texts a database server would convert to XML.

Spark's own ``from_xml`` reads one document and knows no namespaces, so the texts go in
Arrow batches to a parser of the workers' Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of elements that the server's XML type can hold.
DEPTH = 128


def _accepts(wide: bool, depth: int):
    """A test of one text. Everything it needs is inside, so that workers need no code of this package."""
    import re
    from xml.parsers import expat

    # A declaration stands at the very beginning, or it is an error.
    quoted = r"""\s*=\s*(?:"{0}"|'{0}')"""
    declaration = re.compile(
        r"<\?xml\s+version" + quoted.format(r"1\.0")
        + r"(?:\s+encoding\s*=\s*(?P<encoding>\"[A-Za-z][\w.-]*\"|'[A-Za-z][\w.-]*'))?"
        + r"(?:\s+standalone" + quoted.format("(?:yes|no)") + r")?\s*\?>", re.ASCII,
    )
    two_bytes = ("utf-16", "ucs-2", "iso-10646-ucs-2")

    def accepts(text: str | None) -> bool | None:
        if text is None:
            return None
        declared = declaration.match(text)
        if declared:
            encoding = declared["encoding"]
            # The server does not switch between texts of one and of two bytes a unit.
            if encoding and (encoding[1:-1].lower() in two_bytes) != wide:
                return False
            text = text[declared.end():]
        # A fragment may have several elements, text beside them, or nothing at all; inside an element of its
        # own a DOCTYPE and a second declaration are errors, and so are entities other than the five and numbers.
        parser = expat.ParserCreate(namespace_separator="\n")
        level = deepest = -1  # that element does not count

        def opened(name, attributes):
            nonlocal level, deepest
            level += 1
            deepest = max(deepest, level)

        def closed(name):
            nonlocal level
            level -= 1

        if text.count("<") > depth:  # fewer tags cannot go deeper
            parser.StartElementHandler, parser.EndElementHandler = opened, closed
        try:
            for part in ("<fragment>", text, "</fragment>"):
                parser.Parse(part)
            parser.Parse("", True)
        except expat.ExpatError:
            return False
        return deepest <= depth

    return accepts


def well_formed_xml(column: Column, wide: bool = True, depth: int = DEPTH) -> Column:
    """TRY_CONVERT to XML: the text where the server would take it as XML, else NULL.

    Taken are documents and fragments (several elements, text beside elements, the empty
    text) that are well-formed with their namespaces: prefixes are declared, attributes
    differ. Refused are a DOCTYPE, entities other than the predefined and numeric ones,
    characters that XML does not allow, elements more than ``depth`` levels deep, a
    declaration that is not at the very beginning, and one whose encoding is not that of
    the text: ``wide`` texts (nvarchar) are of two bytes a unit, others (varchar) of one.
    """
    return F.when(F.udf(_accepts(wide, depth), "boolean", useArrow=True)(column), column)
