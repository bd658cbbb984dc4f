"""Models, their typed attributes and links, and changes to them.

A catalog is a value: every change returns a new one, so a batch of changes takes effect as a whole
or, if one of them is refused, not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from stemma.errors import QuestionError

SNAKE_CASE = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*\Z")
RESERVED = ("attributes", "attribute", "all", "identifier")
FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("location", "filename", "original_filename")])
#: Spark types of stored attributes; links have none of their own.
TYPES: dict[str, T.DataType] = {
    "identifier": T.StringType(),
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date_time": T.TimestampNTZType(),
    "shifted_date_time": T.TimestampNTZType(),
    "file": FILE,
    "image": FILE,
    "file_collection": T.ArrayType(FILE),
    "match": T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]),
    "matrix": T.ArrayType(T.DoubleType()),
}
UP, ONE, MANY = ("parent", "link"), ("child",), ("collection", "table")
LINKS = UP + ONE + MANY


@dataclass(frozen=True)
class Attribute:
    """``column`` holds its values (for parent and link: the key of the other model). For child,
    collection and table ``via`` is the attribute of the other model that points back here."""

    name: str
    type: str = "string"
    column: str | None = None
    target: str | None = None
    via: str | None = None
    options: tuple[str, ...] = ()
    validation: tuple | None = None
    restricted: bool = False
    hidden: bool = False
    read_only: bool = False
    unique: bool = False
    display_name: str | None = None
    description: str | None = None
    format_hint: str | None = None
    group: str | None = None

    @property
    def stored(self) -> str:
        return self.column or (f"{self.name}_id" if self.type in UP else self.name)

    @property
    def model(self) -> str:
        return self.target or self.name

    def template(self) -> dict:
        out = {"name": self.name, "attribute_type": self.type, "display_name": self.display_name or self.name.replace("_", " ").title()}
        more = {"link_model_name": self.model if self.type in LINKS else None, "link_attribute_name": self.via, "options": list(self.options) or None, "validation": self.validation, "description": self.description, "format_hint": self.format_hint, "attribute_group": self.group, "column_name": self.column}
        return out | {k: v for k, v in more.items() if v is not None} | {k: getattr(self, k) for k in ("restricted", "hidden", "read_only", "unique")}


@dataclass(frozen=True)
class Model:
    """``key`` is the column that other models' links hold; ``identity`` the attribute by which records are known."""

    name: str
    attributes: tuple[Attribute, ...] = ()
    key: str = "id"
    identity: str | None = None
    root: bool = False
    #: One record at most, as of a project.
    single: bool = False
    version: int = 0
    dictionary: tuple[str, tuple[tuple[str, str], ...]] | None = None
    date_shift_root: bool = False

    def __iter__(self) -> Iterator[Attribute]:
        return iter(self.attributes)

    def find(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def get(self, name: str) -> Attribute:
        if (found := self.find(name)) is None:
            raise QuestionError(f"{name} is not a valid attribute of {self.name}")
        return found

    @property
    def parent(self) -> Attribute | None:
        return next((a for a in self.attributes if a.type == "parent"), None)

    @property
    def identifier(self) -> str:
        """The column of the identity, else the key."""
        return self.get(self.identity).stored if self.identity else self.key

    def template(self) -> dict:
        return {"name": self.name, "identifier": self.identity or self.key, "parent": self.parent.model if self.parent else None, "version": self.version, "dictionary": self.dictionary and {"dictionary_model": self.dictionary[0], "attributes": dict(self.dictionary[1])}, "date_shift_root": self.date_shift_root, "attributes": {a.name: a.template() for a in self}}

    def schema(self) -> T.StructType:
        """Of the stored columns."""
        fields = [T.StructField(self.key, T.LongType())]
        fields += [T.StructField(a.stored, TYPES.get(a.type, T.LongType())) for a in self if a.type not in ONE + MANY and a.stored != self.key]
        return T.StructType([*fields, T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType())])


@dataclass(frozen=True)
class User:
    """What the asker may do."""

    can_view: bool = True
    can_edit: bool = False
    is_admin: bool = False
    can_see_restricted: bool = False


@dataclass(frozen=True)
class Catalog:
    project: str
    models: dict[str, Model] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not any(m.root for m in self.models.values()) and self.models:
            raise QuestionError("a project needs a root model")
        for m in self.models.values():
            if m.name in RESERVED or not SNAKE_CASE.match(m.name):
                raise QuestionError(f"{m.name} is not a valid model name")
            if not m.root and not any(a.type in LINKS for a in m):
                raise QuestionError(f"{m.name} is an orphan: it has no links")
            for a in m:
                if not SNAKE_CASE.match(a.name):
                    raise QuestionError(f"{a.name} is not a valid attribute name")
                if a.type not in TYPES and a.type not in LINKS:
                    raise QuestionError(f"{a.type} is not an attribute type")
                if a.type in LINKS and a.model not in self.models:
                    raise QuestionError(f"{m.name}.{a.name} links to {a.model}, which does not exist")

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise QuestionError(f"Could not find model {self.project}::{name}")
        return self.models[name]

    def back(self, model: Model, a: Attribute) -> Attribute:
        """The attribute of the other model that points to ``model`` by way of child, collection or table ``a``."""
        other = self.model(a.model)
        for b in other:
            if b.type in UP and b.model == model.name and a.via in (None, b.name):
                return b
        raise QuestionError(f"{other.name} has no link back to {model.name}.{a.name}")

    def ancestors(self, model: Model) -> list[tuple[Model, list[Attribute]]]:
        """(model, path of parent attributes to it), itself first."""
        out, path = [(model, [])], []
        while (up := out[-1][0].parent) is not None and len(out) <= len(self.models):
            path = [*path, up]
            out.append((self.model(up.model), path))
        return out

    def shift_path(self, model: Model) -> list[Attribute] | None:
        """The parent attributes up to the date shift root; None if there is none."""
        return next((path for m, path in self.ancestors(model) if m.date_shift_root), None)

    # changes

    def _with(self, *models: Model) -> Catalog:
        return replace(self, models=self.models | {m.name: replace(m, version=m.version + 1) for m in models})

    def _edit(self, model: str, name: str, /, **changes) -> Model:
        m = self.model(model)
        m.get(name)
        return replace(m, attributes=tuple(replace(a, **changes) if a.name == name else a for a in m))

    def add_model(self, name: str, identifier: str | None, parent: str, link: str = "collection") -> Catalog:
        """A model below ``parent``, which gets a ``link`` (child, collection or table) to it."""
        if name in self.models:
            raise QuestionError(f"{name} already exists")
        if link not in ONE + MANY:
            raise QuestionError(f"{link} does not link to children")
        if link != "table" and not identifier:
            raise QuestionError(f"{name} needs an identifier")
        own = ((Attribute(identifier, "identifier", unique=True),) if identifier else ()) + (Attribute(parent, "parent"),)
        above = self.model(parent)
        if above.find(name):
            raise QuestionError(f"{parent} already has an attribute {name}")
        return self._with(Model(name, own, identity=identifier), replace(above, attributes=(*above.attributes, Attribute(name, link))))

    def add_attribute(self, model: str, attribute: Attribute) -> Catalog:
        m = self.model(model)
        if m.find(attribute.name):
            raise QuestionError(f"{model}.{attribute.name} already exists")
        if attribute.type in LINKS or attribute.type == "identifier":
            raise QuestionError(f"{attribute.type} attributes are added with links and models")
        return self._with(replace(m, attributes=(*m.attributes, attribute)))

    EDITABLE = ("description", "display_name", "hidden", "group", "read_only", "restricted", "unique", "validation", "options")

    def update_attribute(self, model: str, name: str, **changes) -> Catalog:
        if wrong := [k for k in changes if k not in self.EDITABLE]:
            raise QuestionError(f"{', '.join(wrong)} can't be changed")
        return self._with(self._edit(model, name, **changes))

    def rename_attribute(self, model: str, name: str, new: str) -> Catalog:
        """The column keeps its name."""
        m = self.model(model)
        if m.find(new):
            raise QuestionError(f"{model}.{new} already exists")
        a = m.get(name)
        changed = self._edit(model, name, name=new, column=a.stored if a.type not in ONE + MANY else None, target=a.model if a.type in LINKS else None)
        changed = replace(changed, identity=new if m.identity == name else m.identity)
        others = []
        if a.type in UP:
            for b in (other := self.model(a.model)):
                if b.type in ONE + MANY and b.model == model and self.back(other, b).name == name:
                    others.append(replace(other, attributes=tuple(replace(x, via=new) if x.name == b.name else x for x in other)))
        return self._with(changed, *others)

    def add_link(self, model: str, name: str, other: str, back_name: str, back_type: str = "collection") -> Catalog:
        """A link from ``model`` to ``other``, and its reciprocal."""
        if back_type not in ("collection", "child"):
            raise QuestionError("a link's reciprocal is a collection or a child")
        one, two = self.model(model), self.model(other)
        if one.find(name) or two.find(back_name) or (model == other and name == back_name):
            raise QuestionError(f"{model}.{name} or {other}.{back_name} already exists")
        there, here = Attribute(name, "link", target=other), Attribute(back_name, back_type, target=model, via=name)
        if model == other:
            return self._with(replace(one, attributes=(*one.attributes, there, here)))
        return self._with(replace(one, attributes=(*one.attributes, there)), replace(two, attributes=(*two.attributes, here)))

    def add_dictionary(self, model: str, dictionary: str, matches: dict[str, str]) -> Catalog:
        """``matches``: attribute of ``model`` to attribute of ``dictionary``."""
        m, d = self.model(model), self.model(dictionary)
        for a, b in matches.items():
            m.get(a), d.get(b)
        return self._with(replace(m, dictionary=(dictionary, tuple(matches.items()))))

    def set_date_shift_root(self, model: str, on: bool = True) -> Catalog:
        m = self.model(model)
        above = self.model(m.parent.model) if m.parent else None
        if on and above and any(a.type == "table" and a.model == model for a in above):
            raise QuestionError("a table can't be the date shift root")
        if on and any(x.date_shift_root for x in self.models.values() if x.name != model):
            raise QuestionError("a project has one date shift root")
        return self._with(replace(m, date_shift_root=on))

    def apply(self, changes: Sequence[tuple], versions: dict[str, int] | None = None) -> Catalog:
        """All of ``changes``, (method, arguments...), or none; ``versions`` must still hold."""
        for name, version in (versions or {}).items():
            if self.model(name).version != version:
                raise QuestionError(f"{name} was changed meanwhile")
        out = self
        for method, *args in changes:
            more = args.pop() if args and isinstance(args[-1], dict) and method == "update_attribute" else {}
            if method not in ("add_model", "add_attribute", "update_attribute", "rename_attribute", "add_link", "add_dictionary", "set_date_shift_root"):
                raise QuestionError(f"{method} is not a change")
            out = getattr(out, method)(*args, **more)
        return out
