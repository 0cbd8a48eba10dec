"""Types of the graph's tables. Every table also carries `ord`, its order."""

from __future__ import annotations

DOCUMENT = "id string, title string, content string, source_path string, metadata map<string,string>, ord long"
ENTITY = "name string, type string, description string, source_chunks array<string>, confidence double, properties map<string,string>"
RELATIONSHIP = "source_entity string, target_entity string, relationship_type string, description string, source_chunks array<string>, confidence double, properties map<string,string>"
