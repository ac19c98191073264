from foldscape.cli import main

main()
