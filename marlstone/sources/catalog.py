"""The catalog's tables: declared columns, keys, source fields and their coercions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {
    "text": T.StringType(), "int": T.IntegerType(), "smallint": T.ShortType(), "bool01": T.BooleanType(),
    "rating": T.DecimalType(3, 1), "list": T.ArrayType(T.StringType()), "json": T.StringType(),
}


@dataclass(frozen=True)
class Dataset:
    """file: name of the dump; fields: (source field, column, coercion); key: the primary key; required: columns that must not be null."""

    file: str
    fields: tuple[tuple[str, str, str], ...]
    key: tuple[str, ...]
    required: tuple[str, ...]
    optional: bool = False

    @property
    def schema(self) -> T.StructType:
        """Columns as loaded: those of fields, then metadata (JSON text)."""
        columns = [T.StructField(c, _TYPES[kind], c not in self.required) for _, c, kind in self.fields]
        return T.StructType([*columns, T.StructField("metadata", T.StringType())])


def _fields(text: str) -> tuple[tuple[str, str, str], ...]:
    return tuple(tuple(line.split()) for line in text.strip().splitlines())


#: Source fields, columns and coercions (fixed values).
DATASETS: dict[str, Dataset] = {
    "title_ratings": Dataset("title.ratings.tsv.gz", _fields("tconst tconst text\naverageRating average_rating rating\nnumVotes num_votes int"), ("tconst",), ("tconst",)),
    "title_episode": Dataset("title.episode.tsv.gz", _fields("tconst tconst text\nparentTconst parent_tconst text\nseasonNumber season_number int\nepisodeNumber episode_number int"), ("tconst",), ("tconst", "parent_tconst")),
    "title_crew": Dataset("title.crew.tsv.gz", _fields("tconst tconst text\ndirectors directors list\nwriters writers list"), ("tconst",), ("tconst",)),
    "title_basics": Dataset(
        "title.basics.tsv.gz",
        _fields("tconst tconst text\ntitleType title_type text\nprimaryTitle primary_title text\noriginalTitle original_title text\nisAdult is_adult bool01\nstartYear start_year smallint\nendYear end_year smallint\nruntimeMinutes runtime_minutes int\ngenres genres list"),
        ("tconst",), ("tconst",),
    ),
    "name_basics": Dataset("name.basics.tsv.gz", _fields("nconst nconst text\nprimaryName primary_name text\nbirthYear birth_year smallint\ndeathYear death_year smallint\nprimaryProfession primary_profession list\nknownForTitles known_for_titles list"), ("nconst",), ("nconst",)),
    "title_principals": Dataset("title.principals.tsv.gz", _fields("tconst tconst text\nordering ordering int\nnconst nconst text\ncategory category text\njob job text\ncharacters characters json"), ("tconst", "ordering"), ("tconst", "ordering", "nconst")),
    "title_akas": Dataset("title.akas.tsv.gz", _fields("titleId title_id text\nordering ordering int\ntitle title text\nregion region text\nlanguage language text\ntypes types list\nattributes attributes list\nisOriginalTitle is_original_title bool01"), ("title_id", "ordering"), ("title_id", "ordering"), optional=True),
}


def select_datasets(names: list[str] | None = None, include_optional: bool = False) -> list[str]:
    """Table names in declared order. Names may use dots; unknown ones are an error. Without names: all, optional ones only if asked for."""
    if not names:
        return [n for n, d in DATASETS.items() if include_optional or not d.optional]
    wanted = {n.replace(".", "_") for n in names}
    if unknown := wanted - DATASETS.keys():
        raise ValueError(f"unknown datasets: {', '.join(sorted(unknown))}")
    return [n for n in DATASETS if n in wanted]
