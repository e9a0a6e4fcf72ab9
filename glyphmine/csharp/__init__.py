"""Scanner and parser for C# sources."""
