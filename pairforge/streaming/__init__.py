"""Monitoring of progress logs as streams: an extension, not needed by the pipelines."""
