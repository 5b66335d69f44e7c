"""Plans: the registered queries. Importing this package registers all of them."""

from parchment.plans import corpus, evidence, jobs, literals, registry, statistics, text  # noqa: F401
