"""Column functions: text, language and array arithmetic, all JVM-side."""
