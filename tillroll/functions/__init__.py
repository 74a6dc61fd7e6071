"""``Column -> Column`` builders.  Everything here compiles to built-in
Spark expressions (whole-stage codegen, no Python in the task)."""
