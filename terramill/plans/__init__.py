"""Registered queries over the tables and their SQL."""

from terramill.plans import attributes, core, generated, spatial, storage

REGISTERED = (core, spatial, attributes, generated, storage)
